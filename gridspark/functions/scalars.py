"""Scalar column functions (text keys, booleans, numbers, conditionals). All stay in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _assigned() -> Iterator[str]:
    return (c for c in map(chr, range(0xA0, 0x110000)) if unicodedata.category(c) not in ("Cn", "Co", "Cs"))


def _tables(form: str, ascii_only: bool) -> tuple[tuple[str, str], dict[str, str]]:
    """Normal forms of characters, by rule: a translate table for forms of one character, a map for the longer ones."""
    source, target, longer = [], [], {}
    for char in _assigned():
        folded = unicodedata.normalize(form, char)
        if ascii_only:
            folded = folded.encode("ascii", "ignore").decode("ascii")
        if len(folded) > 1:
            longer[char] = folded
        elif folded and folded != char:
            source.append(char)
            target.append(folded)
    return ("".join(source), "".join(target)), longer


def _canonical() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """Canonical decompositions of letters, the classes of combining marks, and the pairs that compose to one character."""
    apart, classes, pairs = {}, {}, {}
    for char in _assigned():
        if unicodedata.combining(char):
            classes[char] = f"{unicodedata.combining(char):03d}"
        whole = unicodedata.normalize("NFD", char)
        if len(whole) > 1 and all(map(unicodedata.combining, whole[1:])):
            apart[char] = whole
            two = unicodedata.normalize("NFC", whole[:-1]) + whole[-1]
            if len(two) == 2 and unicodedata.normalize("NFC", two) == char:
                pairs[two] = char
    return apart, classes, pairs


def _class(chars: Iterable[str], other: bool = False) -> str:
    """A regular expression for one of the characters (or for any other one), written as ranges."""
    codes = sorted(map(ord, chars))
    starts = [c for c, before in zip(codes, [-2, *codes], strict=False) if c != before + 1]
    ends = [c for c, after in zip(codes, [*codes[1:], -2], strict=True) if c != after - 1]
    return ("[^" if other else "[") + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(starts, ends, strict=True)) + "]"


def _map(table: Mapping[str, str]) -> Column:
    """A constant map, written as one text so that plans stay small."""
    return F.str_to_map(F.lit("\x1d".join(f"{k}\x1c{v}" for k, v in table.items())), F.lit("\x1d"), F.lit("\x1c"))


_ASCII_FOLD, _ASCII_LONGER = _tables("NFKD", True)
_COMPAT_FOLD, _COMPAT_LONGER = _tables("NFKC", False)
_APART, _MARKS, _PAIRS = _canonical()
_MARK, _NO_MARK = _class(_MARKS), _class(_MARKS, True)
#: Characters that may change are looked for outside these blocks of letters that never do (a test that most texts pass).
_MAY_FOLD = r"[^\x00-\x9F\xBF-\u0131\u0388-\u03CF\u03FA-\u0482\u0488-\u0586\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FFF\uAC00-\uD7A3\u2010\u2012-\u2016\u2018-\u2023]"

TRUE_WORDS = ("1", "true", "yes")
FALSE_WORDS = ("0", "false", "no")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _chars(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("(?s)."), 0)


def _expand(c: Column, longer: Mapping[str, str]) -> Column:
    """Characters whose form is longer, replaced one by one; texts without any pass.

    Runs of other characters stay whole: a look-up reads half of the map, so only characters that are in it are looked up.
    """
    runs = F.regexp_extract_all(c, F.lit(f"{_class(longer)}|{_class(longer, True)}+"), 0)
    each = F.array_join(F.transform(runs, lambda x: F.when(x.rlike(_class(longer)), F.try_element_at(_map(longer), x)).otherwise(x)), "")
    return F.when(c.rlike(_class(longer)), each).otherwise(c)


def _compose(letter: Column) -> Column:
    """A letter with combining marks: marks in canonical order, each joined to the letter unless a mark before it blocks it."""
    found = _chars(letter)
    apart = F.concat(_chars(F.coalesce(F.try_element_at(_map(_APART), found[0]), found[0])), F.slice(found, 2, F.size(found)))
    ranked = F.transform(apart, lambda x, i: F.struct(F.coalesce(F.try_element_at(_map(_MARKS), x), F.lit("000")).alias("rank"), i.alias("i"), x.alias("x")))
    start = F.struct(F.lit("").alias("letter"), F.lit("").alias("marks"), F.lit("").alias("rank"))

    def join(state: Column, mark: Column) -> Column:
        both = F.try_element_at(_map(_PAIRS), F.concat(state["letter"], mark["x"]))
        first = (state["letter"] == "") & (state["marks"] == "") & (mark["rank"] == "000")
        joined = both.isNotNull() & (state["rank"] < mark["rank"])
        return F.struct(
            F.when(first, mark["x"]).when(joined, both).otherwise(state["letter"]).alias("letter"),
            F.when(first | joined, state["marks"]).otherwise(F.concat(state["marks"], mark["x"])).alias("marks"),
            F.when(first | joined, state["rank"]).otherwise(mark["rank"]).alias("rank"),
        )

    return F.aggregate(F.array_sort(ranked), start, join, lambda s: F.concat(s["letter"], s["marks"]))


def fold_compat(c: Column) -> Column:
    """Compatibility folding (NFKC): forms of one or more characters, then letters and their combining marks composed.

    Two letters that compose with each other (single Hangul jamo, parted Indic vowels) are left as they are.
    """
    wide = _expand(F.translate(c, *_COMPAT_FOLD), _COMPAT_LONGER)
    letters = F.regexp_extract_all(wide, F.lit(f"(?s){_NO_MARK}+(?!{_MARK})|.{_MARK}*"), 0)  # runs of letters without marks stay whole
    composed = F.array_join(F.transform(letters, lambda x: F.when(x.rlike(f"(?s)^.{_MARK}"), _compose(x)).otherwise(x)), "")
    return F.when(c.rlike(_MAY_FOLD), F.when(wide.rlike(_MARK), composed).otherwise(wide)).otherwise(c)


def norm_name(c: Column) -> Column:
    """Area key: lower case, no leading number, separators to blanks, plain ASCII letters."""
    t = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    t = F.regexp_replace(t, r"^[0-9]+[_\-\s]+", "")
    t = F.translate(t, "_-", "  ")
    plain = F.regexp_replace(_expand(F.translate(t, *_ASCII_FOLD), _ASCII_LONGER), r"[^\x00-\x7F]", "")
    t = F.when(t.rlike(r"[^\x00-\x7F]"), plain).otherwise(t)
    return squeeze(F.regexp_replace(t, r"[^a-z0-9\s]", " "))


def norm_optional(c: Column) -> Column:
    key = norm_name(c)
    return F.when(key != "", key)


def name_from_file(c: Column) -> Column:
    """Area key of a file path: base name without the last suffix and outer underscores."""
    stem = F.regexp_replace(F.regexp_extract(c, r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")
    return norm_name(F.regexp_replace(stem, r"^_+|_+$", ""))


def slug(c: Column, default: str = "area") -> Column:
    s = F.replace(norm_name(F.replace(c, F.lit(","), F.lit(" "))), F.lit(" "), F.lit("_"))
    return F.when(s == "", F.lit(default)).otherwise(s)


def display_name(c: Column) -> Column:
    return F.trim(F.split(c, ",")[0])


def title_name(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


# Letters folded in boundary labels, and district words dropped from them.
BOUNDARY_FOLD = {
    "_": " ",
    "-": " ",
    "ı": "i",
    "ï": "i",
    "ü": "u",
    "ұ": "у",
    "қ": "к",
    "ғ": "г",
    "ә": "а",
    "ө": "о",
    "ң": "н",
    "і": "и",
}
BOUNDARY_WORDS = (
    " district",
    " audany",
    " audanyn",
    " audanyi",
    " rayon",
    " raion",
    " ауданы",
    " ауданынын",
    " ауданының",
    " аудан",
)


def norm_boundary(c: Column, words: Sequence[str] = BOUNDARY_WORDS) -> Column:
    """Boundary label: fold letters, drop district words in list order, keep word characters."""
    t = F.lower(F.trim(fold_compat(c)))
    t = F.translate(t, "".join(BOUNDARY_FOLD), "".join(BOUNDARY_FOLD.values()))
    for word in words:
        t = F.replace(t, F.lit(word), F.lit(""))
    return squeeze(F.regexp_replace(t, r"(?U)[^\p{L}\p{N}_\s]", " "))


def norm_question(c: Column) -> Column:
    t = F.lower(fold_compat(F.coalesce(c, F.lit(""))))
    # the look-ahead spares plain letters and digits the slow test of the wide class
    return F.trim(F.regexp_replace(t, r"(?:(?![a-z0-9_])[^\p{L}\p{N}_\-/])+", " "))


def to_bool(c: Column, extra: Sequence[str] = ()) -> Column:
    """Text to boolean; anything outside the vocabulary (and null) is false."""
    words = [*TRUE_WORDS, *extra]
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(words), F.lit(False))


def to_bool3(c: Column) -> Column:
    """Tri-state: unknown words give null."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin(*TRUE_WORDS, "y"), True).when(t.isin(*FALSE_WORDS, "n"), False)


def to_num(c: Column) -> Column:
    """Text to double; bad text, NaN and infinities become null."""
    v = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def to_num_of(df: DataFrame, name: str) -> Column:
    """``to_num`` of a column, without the way over text where the column holds doubles or whole numbers already."""
    if df.schema[name].dataType.typeName() not in ("double", "long", "integer", "short", "byte"):
        return to_num(F.col(name))
    v = F.col(name).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def clean_str(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit("")
    return F.coalesce(F.trim(F.lower(F.col(name))), F.lit(""))


def clean_tag(tags: Column, key: str) -> Column:
    return F.coalesce(F.trim(F.lower(tags[key])), F.lit(""))


def coalesce_cols(df: DataFrame, names: Sequence[str], default: object = None) -> Column:
    """First present column among aliases; names are compared without case."""
    have = {c.lower(): c for c in df.columns}
    for name in names:
        if name.lower() in have:
            return F.col(f"`{have[name.lower()]}`")
    return F.lit(default)


def canonical_key(c: Column, aliases: Mapping[str, str]) -> Column:
    """Lookup key that keeps Cyrillic letters, with an alias table on top."""
    key = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[_\-]+", " ")
    key = squeeze(F.regexp_replace(key, r"[^a-zа-яё0-9 ]+", " "))
    if not aliases:
        return key
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(table[key], key)


def forward_target(c: Column, log_target: bool = True) -> Column:
    return F.log1p(F.greatest(c, F.lit(0.0))) if log_target else c.cast("double")


def inverse_target(c: Column, log_target: bool = True) -> Column:
    return F.expm1(c) if log_target else c.cast("double")


def clip(c: Column, low: float | None = 0.0, high: float | None = None) -> Column:
    if low is not None:
        c = F.greatest(c, F.lit(float(low)))
    if high is not None:
        c = F.least(c, F.lit(float(high)))
    return c


def safe_div(a: Column, b: Column, default: float | None = None) -> Column:
    """Guarded division: null, infinite or near-zero denominators give the default."""
    ok = b.isNotNull() & ~F.isnan(b.cast("double")) & (F.abs(b) > 1e-12) & (F.abs(b) != float("inf"))
    return F.when(ok, F.try_divide(a.cast("double"), b.cast("double"))).otherwise(F.lit(default).cast("double"))


def norm_support(c: Column) -> Column:
    v = c.cast("double")
    return F.coalesce(clip(F.when(v > 1.0, v / 100.0).otherwise(v), 0.0, 1.0), F.lit(0.0))


def log_distance(c: Column) -> Column:
    return F.when(c > 0, F.abs(F.ln(c))).otherwise(F.lit(float("inf")))


def direction(x: Column, y: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Nine-way compass label of a point inside bounds split into thirds."""

    def third(v, lo, hi, low_name, high_name):
        step = (hi - lo) / 3.0
        return (
            F.when(step <= 0, "central")
            .when(v < lo + step, low_name)
            .when(v > hi - step, high_name)
            .otherwise("central")
        )

    ew = third(x, minx, maxx, "west", "east")
    ns = third(y, miny, maxy, "south", "north")
    return F.when(ns == "central", ew).otherwise(F.concat_ws("-", ns, ew))


def protocol_slug(c: Column) -> Column:
    return F.translate(F.lower(F.trim(c)), "- ", "__")


def run_stem(c: Column, default: str = "leave_one_city_out") -> Column:
    """``model__protocol`` file stem as a struct; a missing protocol takes the default."""
    parts = F.split(c, "__", 2)
    return F.struct(
        parts[0].alias("model_name"),
        F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(default)).alias("validation_protocol"),
    )


def first_value(c: Column, order: Column, default: object) -> Column:
    """Aggregate: first non-null value of the group by ``order``, with a default."""
    return F.coalesce(F.min_by(c, F.when(c.isNotNull(), order)), F.lit(default))
