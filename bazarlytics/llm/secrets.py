"""Secrets in texts: fixed rules, and Markov models of random strings and ordinary identifiers.

Everything on the way is a built-in expression. The rules give their spans; a token that no
rule covers is added when its characters are far likelier under the model of random strings
than under that of ordinary words and identifiers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazarlytics.llm.common import fresh

# The rules. Kinds count in this order. A match whose measured part is shorter
# than its least length is dropped after matching, so it still uses up its characters.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # a run of these characters is one match, so its length can stand here
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

#: Characters of a token; a token is a longest run of them.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = r"[A-Za-z0-9+/_=-]+"
LEAST = 20
CHUNK = 256

_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _empty() -> Column:
    return F.array().cast(_SPANS)


def _matches(text: Column, pattern: str, kind: int, measured: int, least: int) -> Column:
    """Spans of all matches, leftmost and not overlapping, whose group `measured` has `least`
    characters. The texts between matches and the matches add up to the places."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = whole if not measured else F.regexp_extract_all(text, F.lit(pattern), F.lit(measured))
    gaps = F.split(text, pattern, -1)
    rows = F.arrays_zip(whole.alias("w"), part.alias("p"), F.slice(gaps, 1, F.size(whole)).alias("g"))

    def step(state, row):
        start = state["at"] + F.length(row["g"])
        end = start + F.length(row["w"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        fits, full = F.length(row["p"]) >= least, F.size(state["now"]) >= CHUNK
        kept = F.when(full, F.array_append(state["done"], state["now"])).otherwise(state["done"])
        now = F.when(full, F.array(span)).otherwise(F.array_append(state["now"], span))
        return F.struct(
            end.alias("at"),
            F.when(fits, now).otherwise(state["now"]).alias("now"),
            F.when(fits, kept).otherwise(state["done"]).alias("done"),
        )

    # spans are gathered in chunks, since adding to an array copies it
    begin = F.struct(F.lit(0).alias("at"), _empty().alias("now"), F.array().cast(f"array<{_SPANS}>").alias("done"))
    return F.aggregate(rows, begin, step, lambda s: F.flatten(F.array_append(s["done"], s["now"])))


def has_assign_word(text: Column) -> Column:
    lower = F.lower(text)
    hits = [lower.contains(w) for w in ASSIGN_WORDS]
    out = hits[0]
    for hit in hits[1:]:
        out = out | hit
    return out


def base_spans(text: Column) -> Column:
    """Spans of the rules, by start and then kind. Each rule runs only where it can match."""
    assign = F.when(has_assign_word(text), _matches(text, ASSIGN, 0, 2, ASSIGN_LEAST)).otherwise(_empty())
    access = F.when(text.contains("AKIA"), _matches(text, ACCESS, 1, 0, ACCESS_LEAST)).otherwise(_empty())
    runs = F.when(text.rlike(HEX), _matches(text, HEX, 2, 0, 0)).otherwise(_empty())
    return F.array_sort(F.concat(assign, access, runs))


def token_spans(text: Column, least: int = LEAST) -> Column:
    """Spans of all tokens of at least that many characters, as kind markov."""
    pattern = TOKEN[:-1] + f"{{{least},}}"
    return F.when(text.rlike(pattern), _matches(text, pattern, 3, 0, 0)).otherwise(_empty())


def _cut(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def _overlaps(span: Column, base: Column) -> Column:
    return F.exists(base, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))


def fit(docs: DataFrame, fit_docs: int = 20_000, smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratios of every character given the one before it, row by row.

    The sample is about `fit_docs` documents, picked by a hash of the text. Its rule matches
    (the value, for an assignment) are the labelled random strings, its other tokens the
    ordinary ones. The counts are at most the squared alphabet, which bounds what is fetched.
    """
    n = docs.count()
    share = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / 1_000_003
    sample = docs.select(F.coalesce("text", F.lit("")).alias("text")).where(share * n < fit_docs)
    spans = sample.select("text", base_spans(F.col("text")).alias("base"))
    value = F.regexp_replace(_cut(F.col("text"), F.col("s")), r"(?i)^(password|passwd|secret|token|api_?key)[^:=]*[:=][\x20\"']*", "")
    secret = spans.select("text", F.explode("base").alias("s")).select(F.lit(1).alias("label"), value.alias("token"))
    rest = F.col("text")
    for pattern in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, pattern, " ")
    plain = spans.select(F.lit(0).alias("label"), F.explode(F.regexp_extract_all(rest, F.lit(TOKEN), F.lit(0))).alias("token"))
    tokens = secret.union(plain.where(F.length("token") >= 4))
    tokens = tokens.groupBy("label", "token").agg(F.count("*").alias("n"))
    pair = F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, F.lit(2)))
    pairs = tokens.where(F.length("token") > 1).select("label", "n", F.explode(pair).alias("pair"))
    counts = {(r.label, r.pair): r.n for r in pairs.groupBy("label", "pair").agg(F.sum("n").alias("n")).collect()}
    table = []
    for a in ALPHABET:
        totals = [sum(counts.get((label, a + b), 0) for b in ALPHABET) + smooth * len(ALPHABET) for label in (0, 1)]
        for b in ALPHABET:
            plain_p, random_p = ((counts.get((label, a + b), 0) + smooth) / totals[label] for label in (0, 1))
            table.append(math.log(random_p / plain_p))
    return table


def ratio(token: Column, table: list[float]) -> Column:
    """The log-likelihood ratio of a token: its steps from character to character add up."""
    # one literal for all values: thousands of them would each be a node of the plan
    values, size = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>"), len(ALPHABET)

    def step(state, char):
        place = F.position(char, F.lit(ALPHABET))
        gain = F.when(state["last"] > 0, F.get(values, (state["last"] - 1) * size + place - 1)).otherwise(0.0)
        return F.struct(place.alias("last"), (state["sum"] + gain).alias("sum"))

    begin = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))
    return F.aggregate(F.split(token, ""), begin, step, lambda s: s["sum"])


def scan(
    docs: DataFrame, table: list[float], least_ratio: float = 12.0, base_name: str = "base", spans_name: str = "spans"
) -> DataFrame:
    """All columns, base (spans of the rules) and spans (those and the model's), as arrays of
    start, kind (a place in KINDS) and end, which is exclusive, in characters.

    A null text counts as empty and has no spans. Repeated rows stay, each with its spans.
    A token that overlaps a rule's span is not added.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    based = docs.withColumn(base_name, base_spans(text))
    base = F.col(base_name)
    likely = F.filter(
        token_spans(text), lambda t: ~_overlaps(t, base) & (ratio(_cut(text, t), table) >= least_ratio)
    )
    return based.withColumn(spans_name, F.array_sort(F.concat(base, likely)))


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    one = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    return F.array_join(one, ",")


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones as one, replaced by a mask."""

    def step(state, span):
        fresh = span["start"] >= state["at"]
        gap = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        out = F.when(fresh, F.concat(state["out"], gap, F.lit(mask))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), out.alias("out"))

    rest = lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.when(F.size(spans) > 0, F.aggregate(spans, begin, step, rest)).otherwise(text)


def redact(docs: DataFrame, **options) -> DataFrame:
    """The documents with their secrets masked and n_chars counted anew where they changed."""
    base, spans = fresh("base", docs.columns), fresh("spans", docs.columns)
    found = scan(docs, fit(docs, **options), base_name=base, spans_name=spans)
    changed = found.withColumn("text", masked(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        n = F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        changed = changed.withColumn("n_chars", n)
    return changed.select(*(F.col(f"`{c}`") for c in docs.columns))
