"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Numbers, names and units become typed placeholders, so a question with other numbers keeps its
template. Windows of template tokens are hashed and joined; every item's windows start at each
token, a document's at every third, so that any run of eight shared tokens meets. A window of fewer
than three literals fits any table or list of names, so it meets by its values instead. A candidate
is then laid over the item token by token: enough tokens must agree (with their values, if they met
by values), and inside a contiguous run slots must be filled consistently (one value of the item
always stands for one value of the document).

Defined cases. Null or empty text, on either side: matches nothing. An item under eight tokens
matches where a document holds its whole token sequence: the values, or a template of three literals
at least. Null ids are carried. Repeated rows: each is judged alike.
Empty tables: no match. Extra columns of documents pass through; those of the benchmark are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dipscan.llm.common import boxed, unboxed
from dipscan.session import materialize

#: Units by name or symbol, as they stand after a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t oz lb lbs ml l gal s sec min h hr hrs day days week weeks month months "
    "year years hour hours minute minutes second seconds meter meters metre metres kilometer kilometers mile "
    "miles inch inches foot feet gram grams kilogram kilograms pound pounds liter liters litre litres degree "
    "degrees percent dollar dollars cent cents euro euros mph kmh km/h m/s hz khz mhz ghz v w kw mw j kj cal kcal"
).split()


@dataclass(frozen=True)
class Templates:
    window: int = 6
    literals: int = 3  # of a window, to meet by its template; one with fewer meets by its values
    stride: int = 3  # of a document's windows
    least_coverage: float = 0.5  # of the item's tokens
    least_run: int = 13  # or so many agreeing tokens in a row, of a long item
    broadcast_windows: int = 2_000_000  # benchmark windows that are broadcast (16 bytes each); more are shuffled


def canonical(text: Column) -> Column:
    """``text`` with each name, number and unit replaced by its placeholder, token for token."""
    named = F.regexp_replace(text, r"(?<=[a-z,;]\s)[A-Z][a-z]+(?=[\s,.;:!?')]|$)", "<name>")
    counted = F.regexp_replace(
        named, r"(^|[\x20\x09-\x0D])[-+#$~('\"\[]*+[0-9][^\x20\x09-\x0D]*", "$1<num>"
    )
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    united = F.regexp_replace(counted, rf"(<num>\s)(?:{units})(?=[\s.,;:!?)]|$)", "$1<unit>")
    return F.regexp_replace(F.lower(united), r"(?<=[\w>])[.,;:!?'\")\]]++(?=\s|$)", "")


def tokens(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+")


def _trimmed(word: Column) -> Column:
    return F.regexp_replace(word, r"^[^\w$]+|[^\w%]+$", "")


def _placeholder(word: Column) -> Column:
    return word.startswith("<")


def _value(template: Column, word: Column) -> Column:
    return F.when(_placeholder(template), F.lower(_trimmed(word))).otherwise(template)


def _hashed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and, token for token: ``h``, hashes of the template; ``r``, the same with slots by value; ``slot``."""
    both = rows.select(*keys, tokens(canonical(F.col("text"))).alias("t"), tokens(F.col("text")).alias("w"))
    return both.select(
        *keys, F.transform("t", lambda t: F.xxhash64(t)).alias("h"), F.zip_with("t", "w", lambda t, w: F.xxhash64(_value(t, w))).alias("r"),
        F.transform("t", _placeholder).alias("slot"),
    )


def _window(at: Column, width: int, cfg: Templates) -> Column:
    """dense and window: the hash of the template, or of the values where the template says too little."""
    dense = width - F.size(F.filter(F.slice("slot", at + 1, width), lambda x: x)) < cfg.literals
    kept = F.when(dense, F.xxhash64(F.slice("r", at + 1, width))).otherwise(F.xxhash64(F.slice("h", at + 1, width)))
    return F.struct(at.alias("place"), dense.alias("dense"), kept.alias("window"))


def _places(width: int, stride: int) -> Column:
    last = F.size("h") - width
    return F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))


def _windows(stride: int, cfg: Templates) -> Column:
    """Every ``stride``-th window: place, dense, window."""
    return F.transform(_places(cfg.window, stride), lambda i: _window(i, cfg.window, cfg))


def _short(width: int, cfg: Templates) -> Column:
    """Every window of ``width`` tokens by its values, and by its template too if that says enough."""
    by_value = lambda i: F.struct(
        i.alias("place"), F.lit(True).alias("dense"), F.xxhash64(F.slice("r", i + 1, width)).alias("window")
    )
    return F.concat(
        F.transform(_places(width, 1), by_value),
        F.filter(F.transform(_places(width, 1), lambda i: _window(i, width, cfg)), lambda x: ~x["dense"]),
    )


def _exploded(hashed: DataFrame, keys: list[str], windows: Column) -> DataFrame:
    return hashed.select(*keys, F.explode(windows).alias("e")).select(*keys, "e.*")


def _runs(laid: Column, agrees: Callable[[Column], Column]) -> Column:
    """The runs of agreeing elements as (first, from 1; n), empty ones between neighboring breaks too."""
    breaks = F.filter(F.transform(laid, lambda x, i: F.when(~agrees(x), i + 1)), lambda i: i.isNotNull())
    ends = F.concat(breaks, F.array(F.size(laid) + 1))
    return F.zip_with(
        F.concat(F.array(F.lit(0)), breaks), ends,
        lambda a, b: F.struct((a + 1).alias("first"), (b - a - 1).alias("n")),
    )


def matches(docs: DataFrame, benchmark: DataFrame, cfg: Templates = Templates()) -> DataFrame:
    """Contaminated rows: doc_id, version (hash of the text), item_id and how far they agree."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.xxhash64("text").alias("version"),
    ).where("text IS NOT NULL")
    # numbered by content: items that share an id or have none stay apart
    items = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
    ).where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).distinct().withColumn("item", F.xxhash64("item_id", "text"))
    least = cfg.window + cfg.stride - 1
    short = F.size("h") < least
    hashed = _hashed(items, ["item"])
    widths = sorted(r[0] for r in hashed.where(short).select(F.size("h")).distinct().collect())
    windows = _windows(1, cfg)
    for n in widths:
        windows = F.when(F.size("h") == n, _short(n, cfg)).otherwise(windows)
    wanted = _exploded(hashed, ["item"], windows).select("item", F.col("place").alias("at"), "dense", "window")
    wanted = materialize(wanted, "windows")
    if wanted.count() <= cfg.broadcast_windows:
        wanted = F.broadcast(wanted)
    # for the widths of short items, if there are any, documents are read at every place
    places = F.concat(_windows(cfg.stride, cfg), *[_short(n, cfg) for n in widths])
    met = (
        _exploded(_hashed(rows, ["doc_id", "version"]), ["doc_id", "version"], places).drop("dense")
        .join(wanted, "window")
        .select("doc_id", "version", "item", (F.col("place") - F.col("at")).alias("shift"), "dense").distinct()
    )
    laid = items.select(
        "item", "item_id", tokens(F.col("text")).alias("iw"), tokens(canonical(F.col("text"))).alias("it")
    )
    found = (
        materialize(met, "candidates").join(laid, "item")
        .join(rows.withColumnRenamed("doc_id", "_d"), (F.col("_d").eqNullSafe(F.col("doc_id"))) & (rows["version"] == met["version"]))
        .select("doc_id", met["version"], "item", "item_id", "shift", "dense", "iw", "it", "text")
    )
    n = F.size("it")
    first = F.greatest(F.col("shift") + 1, F.lit(1))
    skip = F.greatest(-F.col("shift"), F.lit(0))
    found = found.select(
        "doc_id", "version", "item", "item_id", "shift", "dense", n.alias("n_tokens"),
        F.slice("iw", skip + 1, n).alias("iw"), F.slice("it", skip + 1, n).alias("it"),
        F.slice(tokens(F.col("text")), first, n - skip).alias("dw"),
        F.slice(tokens(canonical(F.col("text"))), first, n - skip).alias("dt"),
    )
    # what met by its values is judged by them, what met by its template by that
    agrees = lambda x: F.coalesce(
        F.when(F.col("dense"), _value(x["it"], x["iw"]) == _value(x["dt"], x["dw"])).otherwise(x["it"] == x["dt"]),
        F.lit(False),
    )
    found = found.withColumn("_zip", F.arrays_zip("iw", "it", "dw", "dt"))
    found = found.withColumn("n_agreeing", F.size(F.filter("_zip", agrees))).withColumn("_runs", _runs(F.col("_zip"), agrees))
    # slots are judged inside a run: what stands beside it says nothing about it
    slots = lambda run: F.array_distinct(F.transform(
        F.filter(F.slice("_zip", run["first"], run["n"]), lambda x: _placeholder(x["it"])),
        lambda x: F.struct(
            x["it"].alias("kind"), _trimmed(x["iw"]).alias("mine"), _trimmed(x["dw"]).alias("theirs")
        ),
    ))
    floor = F.least(F.lit(cfg.window), F.col("n_tokens"))
    found = found.withColumn("_judged", F.transform(
        F.filter("_runs", lambda run: run["n"] >= floor), lambda run: F.struct(run["n"].alias("n"), slots(run).alias("slots"))
    ))
    mine = lambda run: F.array_distinct(F.transform(run["slots"], lambda s: F.struct(s["kind"], s["mine"])))
    found = found.withColumn("_best", F.array_max(F.transform(
        F.filter("_judged", lambda run: F.col("dense") | (F.size(mine(run)) == F.size(run["slots"]))),
        lambda run: F.struct(
            run["n"].alias("n"), F.size(run["slots"]).alias("n_slots"),
            F.forall(run["slots"], lambda s: s["mine"] == s["theirs"]).alias("same_values"),
        ),
    ))).select(
        "doc_id", "version", "item", "item_id", "shift", "n_tokens", "n_agreeing", F.col("_best.n").alias("n_run"),
        "_best.n_slots", "_best.same_values",
    )
    # only a run of consistent slots counts; an item too short for windows must be held as a whole
    enough = F.when(F.col("n_tokens") < least, F.col("n_run") >= F.col("n_tokens")).otherwise(
        (F.col("n_run") >= cfg.least_run)
        | ((F.col("n_agreeing") >= cfg.least_coverage * F.col("n_tokens")) & (F.col("n_agreeing") >= least))
    )
    return (
        found.where(F.col("n_run").isNotNull() & enough)
        .groupBy("doc_id", "version", "item", "item_id")
        .agg(F.max(F.struct("n_agreeing", "n_tokens", "n_slots", "same_values", "shift")).alias("best"))
        .select("doc_id", "version", "item_id", "best.*")
    )


def clean(docs: DataFrame, benchmark: DataFrame, cfg: Templates = Templates()) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    hit = matches(docs, benchmark, cfg).select(F.col("doc_id").alias("_d"), F.col("version").alias("_v")).distinct()
    hit = materialize(hit, "contaminated")
    same = F.col("_doc.doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64("_doc.text") == F.col("_v"))
    return unboxed(boxed(docs).join(hit, same, "left_anti"))


def report(docs: DataFrame, benchmark: DataFrame, cfg: Templates = Templates()) -> DataFrame:
    """One row per (doc_id, item_id) that matches."""
    return matches(docs, benchmark, cfg).groupBy("doc_id", "item_id").agg(
        F.max(F.struct("n_agreeing", "n_tokens", "n_slots", "same_values")).alias("best")
    ).select("doc_id", "item_id", "best.*", (F.col("best.n_agreeing") / F.col("best.n_tokens")).alias("coverage"))
