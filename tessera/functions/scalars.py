"""Column expressions of the audit: normalised names, paths, splits, predicates and probabilities. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TRAIN, VAL, TEST, UNASSIGNED = "train", "val", "test", "unassigned"
SPLITS = (TRAIN, VAL, TEST)
LAYOUT_SPLITS = ("train", "training", "val", "validation", "valid", "test", "testing")
ENTROPY_FLOOR = 1e-10


def split_normalised(raw: Column) -> Column:
    """train, val or test by substring, in this order; other names in lower case; null becomes ``unassigned``."""
    s = F.lower(F.trim(raw.cast("string")))
    return F.when(raw.isNull(), UNASSIGNED).when(s.contains("train"), TRAIN).when(s.contains("val"), VAL).when(s.contains("test"), TEST).otherwise(s)


def split_of_folder(part: Column) -> Column:
    """The split that a folder name stands for, null if it is none of the known names."""
    p = F.lower(part)
    return F.when(p.isin(*LAYOUT_SPLITS), F.when(p.contains("train"), TRAIN).when(p.contains("val"), VAL).otherwise(TEST))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def stem(path: Column) -> Column:
    """File name without its last suffix; names that only begin with a dot have no suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def sample_id(id_value: Column, image: Column, ordinal: Column) -> Column:
    """``id_stem``, or the image's stem, or ``sample_000000`` by ordinal. Without an image the ordinal stands for the stem."""
    named = F.when(id_value.isNotNull(), F.concat_ws("_", id_value.cast("string"), F.coalesce(stem(image), ordinal.cast("string"))))
    return F.coalesce(named, stem(image), F.format_string("sample_%06d", ordinal))


def filled(value: Column, default: str) -> Column:
    return F.coalesce(F.trim(value.cast("string")), F.lit(default))


def resolution(text: Column) -> tuple[Column, Column]:
    """Width and height of ``"640 x 480"``; null where either side is no number."""
    s = F.replace(F.lower(text), F.lit(" "), F.lit(""))
    w, h = F.regexp_extract(s, r"^([+-]?\d+)x", 1), F.regexp_extract(s, r"^[^x]*x([+-]?\d+)$", 1)
    both = (w != "") & (h != "")
    return F.when(both, w.try_cast("int")), F.when(both, h.try_cast("int"))


def relative_to_first_marker(path: Column, markers: tuple[str, ...] = ("images/", "annotations/")) -> Column:
    """From the first occurrence of the first marker that occurs; raises if none does. Null stays null."""
    p = F.translate(path, "\\", "/")
    cases = [F.when(p.contains(m), F.substring(p, F.locate(m, p), F.length(p))) for m in markers]
    return F.when(path.isNotNull(), F.coalesce(*cases, F.raise_error(F.concat(F.lit("no marker in path: "), path)).cast("string")))


def relative_to_last_marker(path: Column, marker: str = "images/") -> Column:
    """From the last occurrence of the marker; an empty string for null."""
    return F.when(path.isNull(), F.lit("")).otherwise(F.concat(F.lit(marker), F.substring_index(F.translate(path, "\\", "/"), marker, -1)))


def looks_healthy(disease: Column) -> Column:
    """Profiling: the name contains ``healthy`` or ``normal`` (``abnormal`` too)."""
    return F.lower(disease).contains("healthy") | F.lower(disease).contains("normal")


def healthy_record(disease: Column, affected: Column) -> Column:
    """Manifest: the name contains ``healthy``, or nothing is affected."""
    return F.lower(F.trim(disease)).contains("healthy") | (affected == 0)


def healthy_sample(flag: Column, truth: Column) -> Column:
    """Metrics: flagged, or nothing is true in the mask."""
    return F.coalesce(flag, F.lit(False)) | (truth == 0)


def clipped(x: Column) -> Column:
    """Into [0, 1]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def capitalised(s: Column) -> Column:
    """First character in upper case, all others in lower case."""
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 2**31 - 1)))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x.cast("double") - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def top_k(values: Column, k: int) -> Column:
    """(value, index) of the k largest, larger first, smaller index first among equals."""
    pairs = F.transform(values, lambda x, i: F.struct((-x.cast("double")).alias("neg"), i.alias("index")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct((-p["neg"]).alias("value"), p["index"].alias("index")))


def normalised_entropy(probabilities: Column) -> Column:
    """Entropy over that of the uniform distribution; 0 for a single class. Probabilities below the floor count as the floor."""
    terms = F.aggregate(probabilities, F.lit(0.0), lambda a, p: a - F.greatest(p.cast("double"), F.lit(ENTROPY_FLOOR)) * F.ln(F.greatest(p.cast("double"), F.lit(ENTROPY_FLOOR))))
    n = F.size(probabilities)
    return F.when(n <= 1, F.lit(0.0)).otherwise(F.try_divide(terms, F.ln(F.when(n > 1, n.cast("double")).otherwise(F.lit(2.0)))))


def ratio(a: Column, b: Column, other: float | None = None) -> Column:
    """a / b; ``other`` (or null) where b is 0."""
    q = F.try_divide(a.cast("double"), b.cast("double"))
    return q if other is None else F.coalesce(q, F.lit(other))


def hashed_order(key: Column, seed: int) -> Column:
    """A random but repeatable order of keys, the same in every SQL engine: by the MD5 of key and seed."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def now_iso() -> Column:
    """The time of the query as ISO 8601 text, without a zone, in the session's time zone."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def run_name(prefix: str, at: Column | None = None) -> Column:
    """Name of a run: the prefix and the time (now by default) as yyyyMMdd_HHmmss."""
    return F.concat(F.lit(prefix), F.date_format(F.current_timestamp() if at is None else at, "yyyyMMdd_HHmmss"))
