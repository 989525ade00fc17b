"""Personal data by bootstrapped contextual extraction, in DataFrame and SQL functions only.

Base entities (email, ip, card, phone) come from fixed patterns, leftmost and non-overlapping per kind; matches that fail
their check are dropped. The contextual part finds identifiers no fixed pattern describes: every token of at least
``LEAST`` letters and digits with both in it is a candidate instance. Its lexical patterns are the words and marks in
front of it (``L:``) and its shape (``S:``: hexadecimal, or its first four characters, with its length). Instances in a
seed context (``SEEDS``) start with score 1. Over ``ROUNDS`` rounds a pattern's confidence is the summed score of its
distinct instances over their number plus one, and an instance's score the best confidence among its patterns; patterns
need two distinct instances, so a chance context teaches nothing. Instances that reach ``ACCEPT`` become spans of kind
``id`` wherever they occur, unless a base span overlaps them. After a seed word or a trusted lexical pattern and its mark the
whole value up to white space or a quote is an instance, of any shape and length. Scores use all documents.

Edge cases: null and empty texts have no span; texts of any length are searched whole (patterns are possessive, so no
match recurses or backtracks over a long run); repeated rows are searched each; an empty table gives no rows; extra
columns are ignored by ``report`` and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.llm._io import cut, discard

KINDS = ("email", "ip", "card", "phone", "id")
ROUNDS, ACCEPT, LEAST = 4, 0.5, 10
#: Words in front of an identifier that make it a seed entity.
SEEDS = "password|passwd|pwd|passcode|secret|token|api[ _-]?key|apikey|access[ _-]?key|credential|ssn|iban|passport|account|licen[cs]e[ _-]?no"

# A match can only start where a run starts or where the match before it ended; other starts fail alike.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[ -]?[0-9]){12,}+"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_ID = r"(?:\G|(?<![A-Za-z0-9]))(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{%d,}+" % LEAST
# The whole value, of any shape and length, after a seed word or after any word with a mark.
_VALUE = r"[=:#\"]++ {0,2}\"?[^\s\"]++"
_SEEDED = r"(?i)(?:%s)[A-Za-z_]*+ {0,2}%s" % (SEEDS, _VALUE)
_NAMED = r"(?<![A-Za-z_])[A-Za-z_]++(?:[ _-][A-Za-z_]++)? {0,2}%s" % _VALUE

_LUHN = """aggregate(sequence(1, length({d})), 0, (s, i) -> s + CASE WHEN i % 2 = 1 THEN int(substr({d}, length({d}) - i + 1, 1))
  WHEN int(substr({d}, length({d}) - i + 1, 1)) > 4 THEN 2 * int(substr({d}, length({d}) - i + 1, 1)) - 9 ELSE 2 * int(substr({d}, length({d}) - i + 1, 1)) END) % 10 = 0"""
_DIGITS = "regexp_replace(x.hit, '[^0-9]', '')"
_CHECKS = {
    "email": "true",
    "ip": "forall(split(x.hit, '[.]'), p -> double(p) <= 255)",
    "card": f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN.format(d=_DIGITS)}",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}


def _located(hits: str, gaps: str) -> str:
    """Structs (start, end, hit, gap) of matches and the texts between them, in code points."""
    return f"""aggregate(sequence(1, size({hits})), struct(0L AS at, cast(array() AS array<struct<start:bigint,end:bigint,hit:string,gap:string>>) AS out),
      (a, i) -> struct(a.at + length({gaps}[i - 1]) + length({hits}[i - 1]) AS at,
        concat(a.out, array(struct(a.at + length({gaps}[i - 1]) AS start, a.at + length({gaps}[i - 1]) + length({hits}[i - 1]) AS end, {hits}[i - 1] AS hit, {gaps}[i - 1] AS gap))) AS out),
      a -> a.out)"""


def _matched(df: DataFrame, name: str, pattern: str, when: Column) -> DataFrame:
    """Adds column ``name``: the located matches of a pattern in ``text``."""
    df = df.withColumn("hits", F.when(when, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
    df = df.withColumn("gaps", F.when(F.size("hits") > 0, F.split("text", pattern, -1)))
    empty = "cast(array() AS array<struct<start:bigint,end:bigint,hit:string,gap:string>>)"
    return df.withColumn(name, F.expr(f"CASE WHEN size(hits) > 0 THEN {_located('hits', 'gaps')} ELSE {empty} END")).drop("hits", "gaps")


def found(docs: DataFrame) -> DataFrame:
    """docs with row_key, base (array of (kind, start, end)) and candidates (array of (start, end, value, left, shape))."""
    df = docs.withColumn("row_key", F.monotonically_increasing_id()).withColumn("text", F.coalesce("text", F.lit("")))
    df = df.withColumn("digits", F.col("text").rlike("[0-9]"))
    df = _matched(df, "email", _EMAIL, F.contains("text", F.lit("@")))
    df = _matched(df, "ip", _IP, F.col("digits"))
    df = _matched(df, "card", _CARD, F.col("digits"))
    df = _matched(df, "phone", _PHONE, F.col("digits") & F.contains("text", F.lit("+")))
    df = _matched(df, "ids", _ID, F.col("digits"))
    df = _matched(df, "seeded", _SEEDED, F.col("text").rlike("[=:#\"]"))
    df = _matched(df, "named", _NAMED, F.col("text").rlike("[=:#\"]"))
    kept = [f"transform(filter({k}, x -> {c}), x -> struct({i} AS kind, x.start AS start, x.end AS end))" for i, (k, c) in enumerate(_CHECKS.items())]
    df = df.withColumn("base", F.expr(f"array_sort(concat({', '.join(kept)}))"))
    shape = "CASE WHEN x.hit RLIKE '^[0-9a-f]++$' THEN concat('S:hex', length(x.hit)) ELSE concat('S:', left(x.hit, 4), length(x.hit)) END"
    # The word in front and the marks between it and the token; random prose in front is no lexical pattern.
    left = "concat('L:', lower(regexp_replace(regexp_extract(right(x.gap, 48), '([A-Za-z_]++[ _-]?[A-Za-z_]*+ {0,2}[=:#\"]++ {0,2}[\"]?)$', 1), ' ', '')))"
    free = "filter(ids, x -> NOT exists(base, b -> b.start < x.end AND x.start < b.end))"
    df = df.withColumn("candidates", F.expr(f"transform({free}, x -> struct(x.start AS start, x.end AS end, x.hit AS value, {left} AS left, {shape} AS shape))"))
    for name in ("seeded", "named"):
        front = r"""regexp_extract(x.hit, '^([^=:#"]*+[=:#"]++ {0,2}"?)', 1)""".replace("\\", "\\\\")
        value = f"regexp_replace(substring(x.hit, length({front}) + 1), '[.,;:!?)>}}\\']++$', '')"
        parts = f"transform({name}, x -> struct(x.start + length({front}) AS start, {value} AS hit, concat('L:', lower(replace({front}, ' ', ''))) AS left))"
        whole = f"transform({parts}, x -> struct(x.start AS start, x.start + length(x.hit) AS end, x.hit AS hit, x.left AS left))"
        valid = f"filter({whole}, x -> x.hit <> '' AND NOT exists(base, b -> b.start < x.end AND x.start < b.end))"
        df = df.withColumn(name, F.expr(f"transform({valid}, x -> struct(x.start AS start, x.end AS end, x.hit AS value, x.left AS left, {shape} AS shape))"))
    return df.withColumn("candidates", F.concat("candidates", "seeded")).drop("digits", "email", "ip", "card", "phone", "ids", "seeded")


def _scored(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(value, score) and the trusted left patterns: the pattern-instance graph scored iteratively from its seeds."""
    seed = F.col("left").rlike(f"^L:.*({SEEDS})")
    seeds = places.groupBy("value").agg(F.max(F.when(seed, 1.0).otherwise(0.0)).alias("seed"))
    edges = cut(places.select("value", F.explode(F.array("left", "shape")).alias("pattern")).where("pattern <> 'L:'").distinct().join(seeds, "value"))
    score = cut(edges.groupBy("value").agg(F.max("seed").alias("score")))
    for _ in range(ROUNDS):
        known = edges.join(score, "value")
        trust = known.groupBy("pattern").agg(F.sum("score").alias("mass"), F.count("*").alias("n"))
        trust = trust.select("pattern", F.when(F.col("n") > 1, F.col("mass") / (F.col("n") + 1)).otherwise(0.0).alias("trust"))
        fresh = cut(edges.join(trust, "pattern").groupBy("value").agg(F.greatest(F.max("seed"), F.max("trust")).alias("score")))
        discard(score)
        score = fresh
    trust = edges.join(score, "value").where("pattern LIKE 'L:%'").groupBy("pattern").agg(F.sum("score").alias("mass"), F.count("*").alias("n"))
    return score, trust.where((F.col("n") > 1) & (F.col("mass") / (F.col("n") + 1) >= ACCEPT)).select(F.col("pattern").alias("left"))


def spans(docs: DataFrame) -> DataFrame:
    """``docs`` with row_key, base and extra: the sorted arrays of base spans and of discovered ones."""
    marked = cut(found(docs))
    places = marked.where(F.size("candidates") > 0).select("row_key", F.explode("candidates").alias("c")).select("row_key", "c.*")
    score, trusted = _scored(places)
    named = marked.where(F.size("named") > 0).select("row_key", F.explode("named").alias("c")).select("row_key", "c.*").join(trusted, "left")
    hit = places.join(score.where(F.col("score") >= ACCEPT).select("value"), "value").select("row_key", "start", "end").union(named.select("row_key", "start", "end"))
    extra = hit.groupBy("row_key").agg(F.array_sort(F.collect_set(F.struct(F.lit(4).alias("kind"), "start", "end"))).alias("extra"))
    # A span inside a longer one says nothing more.
    extra = extra.withColumn("extra", F.expr("filter(extra, x -> NOT exists(extra, y -> y.start <= x.start AND x.end <= y.end AND y.end - y.start > x.end - x.start))"))
    none = F.expr("cast(array() AS array<struct<kind:int,start:bigint,end:bigint>>)")
    return marked.drop("candidates", "named").join(extra, "row_key", "left").withColumn("extra", F.coalesce("extra", none))


def _listed(column: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({column}, x -> concat(array({names})[x.kind], ':', x.start, ':', x.end)), ',')")


def report(docs: DataFrame) -> DataFrame:
    """Per document: counts by kind (``n_id``: discovered spans; ``n_spans``: all), the hash of its base spans and all spans."""
    df = spans(docs.select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {i})) AS bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    more = [F.size("extra").cast("long").alias("n_id"), (F.size("base") + F.size("extra")).cast("long").alias("n_spans")]
    return df.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), F.array_join(F.filter(F.array(_listed("base"), _listed("extra")), lambda x: x != ""), ",").alias("spans"), *more)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; ``n_chars``, where there is one, follows a changed text. A null
    text becomes empty. All columns but the text travel in one struct, so no name of theirs meets one used here."""
    others = [c for c in docs.columns if c != "text"]
    given = docs.select("text", F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("rest"))
    df = spans(given).withColumn("all", F.expr("array_sort(transform(concat(base, extra), x -> struct(x.start AS start, x.end AS end, x.kind AS kind)))"))
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    text = F.expr(f"""CASE WHEN size(all) = 0 THEN text ELSE aggregate(all, struct(0L AS at, '' AS out),
      (a, x) -> CASE WHEN x.start >= a.at THEN struct(x.end AS at, concat(a.out, substring(text, int(a.at + 1), int(x.start - a.at)), array({names})[x.kind]) AS out)
                     ELSE struct(greatest(a.at, x.end) AS at, a.out AS out) END,
      a -> concat(a.out, substring(text, int(a.at + 1)))) END""")
    df = df.withColumn("clean", text)

    def column(c: str) -> Column:
        if c == "text":
            return F.col("clean")
        own = F.col("rest").getField(f"c{others.index(c)}")
        return F.when(F.size("all") > 0, F.length("clean").cast(docs.schema[c].dataType)).otherwise(own) if c == "n_chars" else own

    return df.select(*[column(c).alias(c) for c in docs.columns])
