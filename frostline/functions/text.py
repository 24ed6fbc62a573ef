"""Parsing of scores in text, prompts, chat templates and normalised tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a probability looks like inside text, by form of the parser.
INNER = {
    "a": r"(?<![\d.])(?:0(?:\.\d+)?|1(?:\.0+)?)(?!\d)",
    "b": r"(?<!\d)(?:0(?:\.\d+)?|1(?:\.0+)?)(?!\d)",
    "c": r"(?<![\d.])(?:0\.\d+|1\.0+)(?!\d)",
    "d": r"(?<![\d.])(?:0\.\d+|1(?:\.0+)?|0)(?!\d)",
}


def parse_probability(x: Column, form: str = "a", fallback: float | None = None) -> Column:
    """A probability in [0, 1] from text, else null.

    Forms a, b and d take the whole text as a number first and search it after; form c searches first and
    takes a whole text of 0 or 1 after, else ``fallback``.
    """
    found = F.nullif(F.regexp_extract(x, f"({INNER[form]})", 1), F.lit("")).try_cast("double")
    if form == "c":
        whole = F.when(F.trim(x).isin("0", "1"), F.trim(x).cast("double"))
        return F.coalesce(found, whole, F.lit(fallback).cast("double"))
    whole = F.trim(x).try_cast("double")
    value = F.coalesce(whole, found)
    return F.when(~F.isnan(value) & value.between(0, 1), value)


def token(x: Column) -> Column:
    """Lower case, runs of other characters to one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def safe_stem(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9_.-]+", "_")


def shortened(x: Column, n: int) -> Column:
    """White space collapsed; what exceeds n characters gives way to three dots."""
    flat = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n - 3), F.lit("..."))).otherwise(flat)


def chat(template: str, instruction: Column, text: Column) -> Column:
    """A prompt in one of three chat forms."""
    joined = F.concat(instruction, F.lit("\n"), text)
    if template == "legacy":
        return F.concat(F.lit("[INST] "), joined, F.lit(" [/INST] "))
    if template == "llama3":
        return F.concat(F.lit("<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\n"), joined, F.lit("<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n"))
    if template == "qwen":
        return F.concat(F.lit("<|im_start|>user\n"), joined, F.lit("<|im_end|>\n<|im_start|>assistant\n"))
    raise ValueError(template)


def float_tag(x: Column) -> Column:
    """Two decimals with ``p`` for the point."""
    return F.replace(F.format_string("%.2f", x), F.lit("."), F.lit("p"))


def map_text(m: Column, n: int = 8) -> Column:
    """A map as ``key: value`` pairs parted by semicolons, the first n of them."""
    return F.array_join(F.transform(F.slice(F.map_entries(m), 1, n), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"].cast("string"), F.lit("")))), "; ")


def list_text(x: Column, n: int = 8) -> Column:
    """The first n elements of a list, parted by semicolons."""
    return F.array_join(F.slice(x, 1, n), "; ")


def year_token(title: Column) -> Column:
    """``year_1999`` where a title holds a year in brackets, else empty."""
    year = F.regexp_extract(title, r"\((\d{4})\)", 1)
    return F.when(year == "", F.lit("")).otherwise(F.concat(F.lit("year_"), year))


def coded(code: Column, names: dict, unknown: str = "unknown") -> Column:
    """What a code stands for."""
    pairs = F.create_map(*[F.lit(x) for item in names.items() for x in item])
    return F.coalesce(F.try_element_at(pairs, code), F.lit(unknown))


#: Other names of the strict cold split.
STRICT = ("strict", "cold", "strict_cold")


def metric_parts(name: Column) -> Column:
    """(split, metric, k) of names as ``warmup_recall@20``; other names of the strict cold split give that name."""
    part = lambda k: F.regexp_extract(F.trim(name), r"^(?:(.*)_)?([a-z]+)@(\d+)$", k)
    split = F.when(part(1).isin(*STRICT), "strict_cold").when(part(1) == "", "overall").otherwise(part(1))
    return F.struct(split.alias("split"), part(2).alias("metric"), part(3).try_cast("int").alias("k"))


def key_values(x: Column) -> Column:
    """A map from text as ``a=1,b=2``; spaces around names and values go."""
    entries = F.transform(F.filter(F.split(x, ","), lambda e: F.trim(e) != ""), lambda e: F.struct(F.trim(F.split_part(e, F.lit("="), F.lit(1))).alias("k"), F.trim(F.split_part(e, F.lit("="), F.lit(2))).alias("v")))
    return F.map_from_entries(entries)


def parsed_date(x: Column) -> Column:
    """A day as ``2024-01-31``, at midnight; other text is null."""
    return F.try_to_timestamp(x, F.lit("yyyy-MM-dd"))


def rendered(template: str, **columns: Column) -> Column:
    """A template's text with ``{name}`` replaced by columns; null ones are empty."""
    out = F.lit(template)
    for name, value in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def nested_text(json: Column, most: int = 8, rest: int = 4, depth: int = 4) -> Column:
    """A JSON value as text: a string as it is, an object's ``key: value`` pairs and a list's elements parted by semicolons.

    The first ``most`` of the outermost level are told, the first ``rest`` of each deeper one, in the order of the
    text; what lies deeper than ``depth`` levels stays JSON.  Null is empty, and so is what isn't JSON.  VARIANT values say
    what each part is.
    """

    def scalar(raw: Column, kind: Column) -> Column:
        number = raw.try_cast("double").cast("string")
        return F.when(kind == "BOOLEAN", F.initcap(raw)).when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.coalesce(number, raw)).when(kind == "VOID", F.lit("")).otherwise(F.coalesce(raw, F.lit("")))

    def with_kind(variant: Column, then) -> Column:
        """``then`` of a variant's kind, which is found once, however often it is used."""
        return F.get(F.transform(F.array(F.schema_of_variant(variant)), then), F.lit(0))

    def walk(raw: Column, kind: Column, n: int, left: int) -> Column:
        if not left:
            return scalar(raw, kind)
        # A level is parsed once for its texts and once for its kinds; its parts don't parse it again.
        fields, typed = F.map_entries(F.from_json(raw, "map<string,string>")), F.map_values(F.from_json(raw, "map<string,variant>"))
        object_ = F.transform(F.slice(F.arrays_zip(fields.alias("a"), typed.alias("b")), 1, n), lambda x: F.concat(x["a"]["key"], F.lit(": "), with_kind(x["b"], lambda kind: walk(x["a"]["value"], kind, rest, left - 1))))
        items, kinds = F.from_json(raw, "array<string>"), F.from_json(raw, "array<variant>")
        list_ = F.transform(F.slice(F.arrays_zip(items.alias("a"), kinds.alias("b")), 1, n), lambda x: with_kind(x["b"], lambda kind: walk(x["a"], kind, rest, left - 1)))
        return F.when(kind.startswith("OBJECT"), F.array_join(object_, "; ")).when(kind.startswith("ARRAY"), F.array_join(list_, "; ")).otherwise(scalar(raw, kind))

    value = F.try_parse_json(json)
    text = lambda kind: F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).otherwise(json)
    return F.when(value.isNull(), F.lit("")).otherwise(F.coalesce(with_kind(value, lambda kind: walk(text(kind), kind, most, depth)), F.lit("")))
