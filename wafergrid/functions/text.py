"""Text, label and path rules as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wafergrid.functions.paths import strip_blank

#: Spellings of splits and labels, and path parts that tell labels, splits and masks.
SPLITS = {"train": "train", "training": "train", "val": "val", "valid": "val", "validation": "val", "test": "test", "testing": "test"}
NORMAL = ("0", "normal", "good", "ok", "negative", "false")
ANOMALOUS = ("1", "anomaly", "anomalous", "defect", "defective", "bad", "positive", "true")
ANOMALOUS_PARTS = ("bad", "defect", "defects", "anomaly", "anomalous", "abnormal")
SPLIT_PARTS = ("train", "val", "valid", "validation", "test")
MASK_PARTS = ("mask", "masks", "ground_truth", "groundtruth", "annotation", "annotations", "gt")
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff")
TEST_MARKERS = ("_test", "-test", "test", "tested")
TEMPLATES = (("_test", "_temp"), ("_test", "_template"), ("_test", "_tpl"), ("test", "temp"), ("test", "template"), ("tested", "template"))
CLASS_NAMES = {1: "open", 2: "short", 3: "mousebite", 4: "spur", 5: "spurious_copper", 6: "pin_hole"}


def split_name(c: Column) -> Column:
    """'train', 'val', 'test', or NULL for anything else."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in SPLITS.items() for x in kv]), F.lower(strip_blank(c)))


def first_value(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of the named columns (whatever their case) whose value isn't NULL or blank, trimmed; missing columns are passed over."""
    own = {c.lower(): c for c in df.columns}
    found = [own[n.lower()] for n in names if n.lower() in own]
    values = [F.nullif(strip_blank(df[c].cast("string")), F.lit("")) for c in found]
    return F.coalesce(*values) if values else F.lit(None).cast("string")


def parts(path: Column) -> Column:
    return F.split(F.lower(path), "/")


def has_part(path: Column, names: Sequence[str]) -> Column:
    return F.coalesce(F.arrays_overlap(parts(path), F.array(*map(F.lit, names))), F.lit(False))


def label_value(value: Column, mask: Column, path: Column) -> Column:
    """0 or 1: by the word given, else 1 if there is a mask, else by the parts of the path, else 0."""
    word = F.lower(strip_blank(value))
    given_mask = F.nullif(strip_blank(mask), F.lit("")).isNotNull()
    return F.when(word.isin(*NORMAL), 0).when(word.isin(*ANOMALOUS), 1).when(given_mask, 1).when(has_part(path, ANOMALOUS_PARTS), 1).otherwise(0)


def path_category(path: Column, categories: Sequence[str]) -> Column:
    """The first of ``categories``, in their order, that is a part of the path; NULL if none is."""
    return F.coalesce(*[F.when(has_part(path, [c.lower()]), F.lit(c)) for c in categories])


def path_split(path: Column) -> Column:
    return F.coalesce(*[F.when(has_part(path, [s]), F.lit(SPLITS[s])) for s in SPLIT_PARTS])


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def stem(path: Column) -> Column:
    """The file name without its last suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def without_marker(c: Column) -> Column:
    """``c`` without its first test marker (the first of the list that occurs), and without - and _ at the ends; NULL if none occurs."""
    low = F.lower(c)
    out = F.lit(None).cast("string")
    for m in reversed(TEST_MARKERS):
        at = F.instr(low, m)
        out = F.when(at > 0, F.btrim(F.concat(F.substr(c, F.lit(1), at - 1), F.substr(c, at + len(m))), F.lit("_-"))).otherwise(out)
    return out


def looks_like_test(path: Column) -> Column:
    return F.lower(stem(path)).rlike("test")


def id_variants(token: Column, stem_: Column, bare: Column) -> Column:
    """As ``split_id_variants``, of a token whose stem, and stem without the mark of a test, are worked out already."""
    base = F.nullif(bare, F.lit(""))
    more = F.when(bare.isNull(), F.array(F.concat(stem_, F.lit("_test")))).otherwise(F.when(base.isNotNull(), F.array(base, F.concat(base, F.lit("_test")))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(F.array(token, file_name(token), stem_), more))


def split_id_variants(token: Column) -> Column:
    """The ways a line of a split list may name a sample: as it is, the file name, the stem, and the stem without or with the mark of a test."""
    return id_variants(token, stem(token), without_marker(stem(token)))


def annotation_stems(path: Column) -> Column:
    """Stems under which an image's annotation may be found, the likeliest first."""
    s = stem(path)
    base = F.nullif(without_marker(s), F.lit(""))
    return F.when(base.isNotNull() & (base != s), F.array(s, base)).otherwise(F.array(s))


def template_stems(path: Column) -> Column:
    """Stems under which a test image's template may be found, in the order of the replacement rules."""
    s, low = stem(path), F.lower(stem(path))
    made = []
    for old, new in TEMPLATES:
        at = F.instr(low, old)
        made.append(F.when(at > 0, F.concat(F.substr(s, F.lit(1), at - 1), F.lit(new), F.substr(s, at + len(old)))))
    return F.array_distinct(F.filter(F.array(*made), lambda x: x.isNotNull() & (x != s)))


def annotation_box(line: Column) -> Column:
    """A struct x1, y1, x2, y2, class_id, class_name of a line of five numbers, parted by commas or blanks; NULL for blank and malformed lines."""
    p = F.filter(F.split(F.regexp_replace(line, r"\s", ","), ","), lambda x: x != "")
    n = [F.get(p, F.lit(i)).try_cast("double") for i in range(5)]
    cls = n[4].cast("int")
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CLASS_NAMES.items() for x in kv]), cls), F.concat(F.lit("class_"), cls.cast("string")))
    good = (F.size(p) == 5) & n[0].isNotNull() & n[1].isNotNull() & n[2].isNotNull() & n[3].isNotNull() & n[4].isNotNull()
    return F.when(good, F.struct(n[0].alias("x1"), n[1].alias("y1"), n[2].alias("x2"), n[3].alias("y2"), cls.alias("class_id"), name.alias("class_name")))


def category_of(path: Column) -> Column:
    """``pcb`` and digits in the parent's name, else in the file's, else the parent's name."""
    parent = F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)
    a, b = F.regexp_extract(parent, r"(pcb\d+)", 1), F.regexp_extract(file_name(path), r"(pcb\d+)", 1)
    return F.when(a != "", a).when(b != "", b).otherwise(parent)


def method_of(name: Column) -> Column:
    """The method that the name of a result folder tells."""
    multi, sam = F.contains(name, F.lit("ms768")), F.endswith(name, F.lit("_sam2"))
    return (
        F.when(F.startswith(name, F.lit("sam2_only_")), "sam2_only").when(sam & multi, "ms768_dinov2_sam2").when(sam, "single_dinov2_sam2")
        .when(multi, "dinov2_ms768_heatmap").when(F.contains(name, F.lit("dinov2")), "dinov2_single_heatmap").otherwise(name)
    )


def safe_filename(c: Column) -> Column:
    """Anything but letters and digits of any script, - and _ to _."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "_")


def whole_numbers(c: Column) -> Column:
    """``'512, 768'`` to an array of integers; empty pieces are passed over."""
    return F.transform(F.filter(F.split(c, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("int"))


#: The words of a flag.
YES, NO = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


def flag(c: Column) -> Column:
    """A word as BOOLEAN; NULL and blank give NULL, any other word fails when it is read."""
    word = F.nullif(F.lower(strip_blank(c)), F.lit(""))
    return F.when(word.isin(*YES), True).when(word.isin(*NO), False).when(word.isNotNull(), F.raise_error(F.concat(F.lit("no flag: "), c)).cast("boolean"))


def fraction(c: Column) -> Column:
    """A number from 0 to 1 written as '0.25', '25%' or '1/4'; NULL and blank give NULL, anything else fails when it is read."""
    word = F.nullif(strip_blank(c), F.lit(""))
    parts_ = F.split(word, "/")
    top, bottom = (F.get(parts_, F.lit(i)).try_cast("double") for i in (0, 1))
    percent = F.regexp_extract(word, r"^(.*)%$", 1).try_cast("double") / 100
    x = F.when(F.endswith(word, F.lit("%")), percent).when(F.size(parts_) == 2, top / F.when(bottom != 0, bottom)).otherwise(word.try_cast("double"))
    return F.when(word.isNull(), None).when((x >= 0) & (x <= 1), x).otherwise(F.raise_error(F.concat(F.lit("no fraction: "), c)).cast("double"))


def report_rank(category: Column, method: Column, methods: Sequence[str]) -> Column:
    """A struct to order a report by: 'macro' first and 'mean' last among the categories, methods in their given order and others after them."""
    place = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, m in enumerate(methods) for x in (m, i)]), method), F.lit(999))
    return F.struct(F.when(category == "macro", 0).when(category == "mean", 2).otherwise(1).alias("a"), category.alias("b"), place.alias("c"), method.alias("d"))


def fixed_point(c: Column, digits: int = 4) -> Column:
    """A number with so many digits, 'inf' and '-inf' as words, '-' for NULL and NaN."""
    x = c.cast("double")
    return F.when(x.isNull() | F.isnan(x), "-").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(F.format_string(f"%.{digits}f", x))


def null_for_nan(c: Column) -> Column:
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def exposes_private_path(c: Column) -> Column:
    """True for absolute paths, home folders, drive letters, ``file:``, backslashes, ``..`` as a part, and text that isn't ASCII."""
    return c.rlike(r"^[/~]|^(?i:file:)|^[A-Za-z]:[/\\]|\\|(^|/)\.\.(/|$)|[^\x00-\x7F]|/(root|home)/")


def relative_to(path: Column, folder: str) -> Column:
    """An absolute path below ``folder`` without it; other paths stay."""
    lead = folder.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(lead)), F.substr(path, F.lit(len(lead) + 1))).otherwise(path)


def class_ids(json: Column) -> Column:
    """``class_ids`` of a JSON object as sorted strings, repeats included; NULL or empty if there are none."""
    return F.array_sort(F.transform(F.from_json(F.get_json_object(json, "$.class_ids"), "array<string>"), lambda x: x))


def markdown_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def public_columns(columns: Sequence[str]) -> list[str]:
    """Column names without those that hold paths."""
    return [c for c in columns if not c.endswith(("_path", "_panel_path", "_paths_json"))]
