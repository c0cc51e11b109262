"""mzML: one task per file, scans streamed out of the XML as Arrow batches."""

from __future__ import annotations

import base64
import gzip
import io
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Accession numbers of the public controlled vocabulary.
MS_LEVEL, POSITIVE, NEGATIVE = "MS:1000511", "MS:1000130", "MS:1000129"
SCAN_TIME, MINUTE = "MS:1000016", "UO:0000031"
SELECTED_MZ, CHARGE = "MS:1000744", "MS:1000041"
F64, F32, ZLIB = "MS:1000523", "MS:1000521", "MS:1000574"
MZ_ARRAY, INTENSITY_ARRAY = "MS:1000514", "MS:1000515"

SCHEMA = (
    "file_name string, scan_number long, ms_level int, precursor_mz double, charge int, rt double, "
    "peaks array<struct<mz double, intensity double>>, precursor_scan long, native_id string"
)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _params(element) -> dict[str, tuple[str, str]]:
    return {p.get("accession"): (p.get("value", ""), p.get("unitAccession", "")) for p in element.iter() if _local(p.tag) == "cvParam"}


def _array(element) -> tuple[str, np.ndarray]:
    params = _params(element)
    text = next((b.text for b in element.iter() if _local(b.tag) == "binary"), None) or ""
    raw = base64.b64decode(text)
    if ZLIB in params and raw:
        raw = zlib.decompress(raw)
    values = np.frombuffer(raw, np.float32 if F32 in params else np.float64).astype(float)
    return ("mz" if MZ_ARRAY in params else "intensity" if INTENSITY_ARRAY in params else ""), values


def _number(text: str | None) -> int | None:
    """The scan number at the end of a native id such as ``... scan=17``."""
    tail = (text or "").rsplit("=", 1)[-1]
    return int(tail) if tail.isdigit() else None


def scans(content: bytes) -> Iterator[dict]:
    """Spectra of one file; elements are dropped as they are read."""
    number = 0
    for _, node in ElementTree.iterparse(io.BytesIO(content)):
        if _local(node.tag) != "spectrum":
            continue
        number += 1
        params = _params(node)
        found: dict = {"scan_number": number, "native_id": node.get("id"), "precursor_mz": None, "charge": None, "precursor_scan": None}
        found["ms_level"] = int(params.get(MS_LEVEL, ("1", ""))[0])
        time, unit = params.get(SCAN_TIME, ("", ""))
        found["rt"] = float(time) * (60 if unit == MINUTE else 1) if time else None
        first = next((p for p in node.iter() if _local(p.tag) == "precursor"), None)
        if first is not None:
            ion = _params(first)
            found["precursor_scan"] = _number(first.get("spectrumRef"))
            if SELECTED_MZ in ion:
                found["precursor_mz"] = float(ion[SELECTED_MZ][0])
            if CHARGE in ion:
                found["charge"] = int(ion[CHARGE][0]) * (-1 if NEGATIVE in params else 1)
        arrays = dict(_array(b) for b in node.iter() if _local(b.tag) == "binaryDataArray")
        mz, inten = arrays.get("mz", np.zeros(0)), arrays.get("intensity", np.zeros(0))
        n = min(len(mz), len(inten))
        found["mz"], found["intensity"] = mz[:n], inten[:n]
        node.clear()
        yield found


def unpacked(content: bytes) -> Iterator[bytes]:
    """The XML texts of a file: itself, or what its gzip or zip packing holds."""
    if content[:2] == b"\x1f\x8b":
        yield gzip.decompress(content)
    elif content[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            yield from (z.read(n) for n in z.namelist() if not n.endswith("/"))
    elif content[:512].lstrip(b"\xef\xbb\xbf \t\r\n")[:1] == b"<":
        yield content
    elif content.strip():
        raise ValueError("neither XML nor gzip nor zip")


_FIELDS = ["scan_number", "ms_level", "precursor_mz", "charge", "rt", "precursor_scan", "native_id"]
_TYPES = [pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.float64(), pa.int64(), pa.string()]


def _batch(path: str, rows: list[dict]) -> pa.RecordBatch:
    flat = [pa.array(np.concatenate([r[c] for r in rows])) for c in ("mz", "intensity")]
    offsets = pa.array(np.append(0, np.cumsum([len(r["mz"]) for r in rows])), pa.int32())
    peaks = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(flat, ["mz", "intensity"]))
    cols = dict(zip(_FIELDS, (pa.array([r[c] for r in rows], t) for c, t in zip(_FIELDS, _TYPES, strict=True)), strict=True))
    cols |= {"file_name": pa.array([path] * len(rows)), "peaks": peaks}
    names = [c.split()[0] for c in ("file_name", *_FIELDS[:5], "peaks", *_FIELDS[5:])]
    return pa.RecordBatch.from_arrays([cols[c] for c in names], names)


def _read(batches: Iterator[pa.RecordBatch], size: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows: list[dict] = []
            for s in (s for text in unpacked(content) for s in scans(text)):
                rows.append(s)
                if len(rows) == size:
                    yield _batch(path, rows)
                    rows = []
            if rows:
                yield _batch(path, rows)


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    """Scans of all levels; retention time in seconds, charge signed by the polarity.

    Files may be packed by gzip or zip.  A file is read by one task, which holds its bytes (2 GB at
    most, the source's limit); scans leave it in batches.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read, SCHEMA).withColumn("metadata", F.create_map().cast("map<string, array<string>>"))


def _param(accession: str, value: object = "") -> str:
    return f'<cvParam accession="{accession}" value="{value}"/>'


def _to_xml(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one mzML text per task."""
    yield pa.RecordBatch.from_arrays([pa.array(["<mzML><run><spectrumList>"])], ["value"])
    for batch in batches:
        lines = []
        for r in batch.to_pylist():
            peaks = r["peaks"] or []
            arrays = "".join(
                f"<binaryDataArray>{_param(F64)}{_param(ZLIB)}{_param(name)}<binary>{base64.b64encode(zlib.compress(np.array([p[c] for p in peaks], float).tobytes())).decode()}</binary></binaryDataArray>"
                for name, c in ((MZ_ARRAY, "mz"), (INTENSITY_ARRAY, "intensity"))
            )
            ion = "" if r["precursor_mz"] is None else _param(SELECTED_MZ, repr(r["precursor_mz"]))
            ion += "" if r["charge"] is None else _param(CHARGE, abs(r["charge"]))
            pole = _param(NEGATIVE if (r["charge"] or 0) < 0 else POSITIVE)
            lines.append(
                f'<spectrum id="scan={r["id"]}">{_param(MS_LEVEL, 2)}{pole}<precursorList><precursor><selectedIonList><selectedIon>{ion}</selectedIon></selectedIonList></precursor></precursorList>'
                f"<binaryDataArrayList>{arrays}</binaryDataArrayList></spectrum>"
            )
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
    yield pa.RecordBatch.from_arrays([pa.array(["</spectrumList></run></mzML>"])], ["value"])


def write_mzml(df: DataFrame, path: str, id_col: str = "scan_number") -> None:
    """A folder of gzip-packed mzML files, one per task, with the peaks, precursor and charge of each row."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), "precursor_mz", "charge", "peaks")
    rows.mapInArrow(_to_xml, "value string").write.mode("overwrite").option("compression", "gzip").text(path)


def scan_trees(scans_df: DataFrame) -> DataFrame:
    """Multi-stage scans with ``collection``: the root of the tree of precursor scans.

    Trees are connected components of the precursor links within a file.
    """
    from ..operators.graph import connected_components

    node = lambda c: F.concat_ws("#", "file_name", F.lpad(F.col(c).cast("string"), 12, "0"))
    links = scans_df.filter(F.col("precursor_scan").isNotNull()).select(node("scan_number").alias("src"), node("precursor_scan").alias("dst"))
    comp = connected_components(links).select(F.col("node").alias("__n"), F.col("component").alias("collection"))
    return scans_df.withColumn("__n", node("scan_number")).join(comp, "__n", "left").withColumn("collection", F.coalesce("collection", "__n")).drop("__n")
