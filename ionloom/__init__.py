"""ionloom: spectral similarity search and large-scale data preparation on PySpark.

Everything is a DataFrame transformation.  Subpackages:

* ``operators``  cleaning, band joins, searches, alignment, binned scoring, graphs,
  and the general data-preparation operators (hot keys, drift, packed fields,
  malformed rows, mergeable percentiles)
* ``sources``    readers and writers for spectral text and XML formats
* ``functions``  Column-level functions: weights, distances, chemistry
* ``plans``      the registered queries and their SQL counterparts
* ``streaming``  searches over a stream of query spectra
* ``llm``        training-text operators (nothing else in the library imports it)
"""

__version__ = "0.2.0"

#: Public names and the modules they come from; they are imported when first used.
_NAMES = {
    "session": ["local_session"],
    "sources.records": ["read_spectra", "read_msp", "read_mgf", "write_spectra", "parse_comments"],
    "sources.mzml": ["read_mzml", "write_mzml", "scan_trees"],
    "operators.clean": ["clean_spectra", "validate", "standardize"],
    "operators.weights": ["peak_table", "Score", "ENTROPY", "UNWEIGHTED_ENTROPY", "COSINE", "cosine"],
    "operators.index": ["write_index", "read_index", "stored"],
    "operators.search": [
        "open_search", "identity_search", "neutral_loss_search", "hybrid_search", "masked_search", "range_search", "top_k", "dense_scores", "with_metadata",
    ],
    "operators.align": ["align", "align_with_mz", "align_strongest", "merge", "hybrid_pair", "matched_peaks", "greedy_cosine", "pair_peaks"],
    "operators.binned": ["discretize", "binned_score", "network_score", "filter_hits"],
    "operators.graph": ["connected_components", "mutual_top_k", "capped_components"],
    "functions.distances": ["distance", "similarity", "normalized", "all_distances"],
    "functions.chem": ["formula_mass", "canonical_formula", "unsaturation", "parse_adduct", "adduct_mz", "enumerate_formulas", "sub_formulas"],
    "operators.hotkeys": ["aggregate_by_key", "latest_per_id"],
    "operators.drift": ["schema_changes", "unify"],
    "operators.packed": ["split_packed"],
    "operators.badrows": ["load_rows", "rejected_rows"],
    "streaming.search": ["search_stream", "scan_counts"],
}
_MODULE_OF = {name: module for module, names in _NAMES.items() for name in names}
__all__ = sorted(_MODULE_OF)


def __getattr__(name: str):
    if name not in _MODULE_OF:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    import importlib

    return getattr(importlib.import_module(f"{__name__}.{_MODULE_OF[name]}"), name)


def _ship_by_value() -> None:
    """Send the package's functions to Python workers by value, so that executors need
    neither an installed copy nor a search path."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
