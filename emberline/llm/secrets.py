"""Secrets in whole texts: three fixed patterns, and strings that look random to character Markov models.

Two first-order models over 63 classes of characters are trained from labelled
samples: random strings (what the fixed patterns find, and digests) and ordinary
identifiers (the shorter words of the same documents outside these spans). A run of key
characters is added as a secret where the log-likelihood ratio of the two models
passes the threshold and no fixed pattern has it. Ratios are whole thousandths,
so sums do not depend on order.

Everything is built from DataFrame functions; the trained table has 63 x 63
numbers and enters the scan as a constant.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table


def _either_case(pattern: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in pattern)


#: Kinds in their order, pattern, group whose length counts, least length.
KINDS = (
    ("assign", "(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]{32,}", 0, 32),
)
ADDED = "markov"
#: Runs that the models judge, and the ratio (in thousandths of a nat) from which they are secrets.
RUN, RUN_LEAST, THRESHOLD = "[A-Za-z0-9+/_=-]{20,}", 20, 15_000
WORD = "[A-Za-z0-9+/_=-]{6,}"
#: Documents to train from (expected number).
TRAIN_DOCS = 2_000
CLASSES = 63
#: Weight of a class's own frequency where a pair was rarely seen.
PRIOR = 5


def no_spans() -> Column:
    return F.expr("cast(array() as array<struct<start:int,stop:int,value:string>>)")


def spans(text: Column, pattern: str, group: int) -> tuple[Column, Column]:
    """The pieces between matches, and structs (hit, value), for ``placed``."""
    some = text.rlike(pattern)
    gaps = F.when(some, F.split(text, pattern, -1))
    hits = F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    values = hits if group == 0 else F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    return gaps, F.arrays_zip(hits.alias("hit"), values.alias("value"))


def placed(gaps: str, hits: str) -> Column:
    """Spans (start, stop, value) in code points from what ``spans`` gave."""
    pairs = F.arrays_zip(F.slice(F.col(gaps), F.lit(1), F.size(hits)).alias("gap"), F.col(hits).alias("hit"))
    first = F.struct(F.lit(0).alias("at"), no_spans().alias("out"))

    def step(s, x):
        start = s["at"] + F.length(x["gap"])
        stop = start + F.length(x["hit"]["hit"])
        one = F.struct(start.alias("start"), stop.alias("stop"), x["hit"]["value"].alias("value"))
        return F.struct(stop.alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

    return F.when(F.col(hits).isNull(), no_spans()).otherwise(F.aggregate(pairs, first, step, lambda s: s["out"]))


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds one column of spans per kind to ``docs(id, text)``."""
    text, df = F.col("text"), docs
    for kind, pattern, group, least in KINDS:
        gaps, hits = spans(text, pattern, group)
        df = df.withColumns({"gaps": gaps, "hits": hits})
        df = df.withColumn(kind, F.filter(placed("gaps", "hits"), lambda x: F.length(x["value"]) >= least)).drop("gaps", "hits")  # noqa: B023
    return df


def char_class(c: Column) -> Column:
    """0-25 lower case, 26-51 upper case, 52-61 digits, 62 anything else."""
    a = F.ascii(c)
    return F.when(a.between(97, 122), a - 97).when(a.between(65, 90), a - 39).when(a.between(48, 57), a + 4).otherwise(62)


def pairs_of(word: Column) -> Column:
    """Neighbouring classes of a string as one number each."""
    classes = F.transform(F.split(word, ""), char_class)
    return F.zip_with(F.slice(classes, F.lit(1), F.size(classes) - 1), F.slice(classes, F.lit(2), F.size(classes) - 1), lambda a, b: a * CLASSES + b)


def id_draw(c: Column | str) -> Column:
    """28 bits of the id's md5."""
    return F.conv(F.substring(F.md5(F.col(c).cast("string") if isinstance(c, str) else c), 1, 7), 16, 10).cast("long")


def outside(text: Column) -> Column:
    """``text`` with a space for each match of a fixed pattern."""
    for _, pattern, _, _ in KINDS:
        text = F.regexp_replace(text, pattern, " ")
    return text


def train(docs: DataFrame, rows: int = TRAIN_DOCS) -> list[int]:
    """Log-likelihood ratios (random over ordinary, in thousandths) of all class pairs."""
    n = docs.filter("id is not null").count()
    limit = rows * (1 << 28) // max(1, n)
    sample = base_spans(docs.filter(id_draw("id") < limit))
    values = F.transform(F.concat(*[F.col(k[0]) for k in KINDS]), lambda x: x["value"])
    digest = F.sha2(F.col("id").cast("string"), 256)
    made = F.array(digest, F.regexp_replace(F.base64(F.unhex(digest)), r"[\r\n]", ""))
    random = sample.select(F.lit(1).alias("random"), F.explode(F.concat(values, made)).alias("word"))
    # Runs long enough to be judged are no evidence for what is ordinary.
    words = F.filter(F.regexp_extract_all(outside(F.col("text")), F.lit(WORD), F.lit(0)), lambda w: F.length(w) < RUN_LEAST)
    ordinary = sample.select(F.lit(0).alias("random"), F.explode(words).alias("word"))
    pairs = random.unionByName(ordinary).select("random", F.explode(pairs_of(F.col("word"))).alias("pair"))
    # At most 63 x 63 rows for each class.
    counts = {(r["random"], r["pair"]): r["n"] for r in pairs.groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = []
    first = {(k, a): sum(counts.get((k, a * CLASSES + b), 0) for b in range(CLASSES)) for k in (0, 1) for a in range(CLASSES)}
    second = {(k, b): sum(counts.get((k, a * CLASSES + b), 0) for a in range(CLASSES)) for k in (0, 1) for b in range(CLASSES)}
    every = {k: sum(first[k, a] for a in range(CLASSES)) for k in (0, 1)}
    for a in range(CLASSES):
        for b in range(CLASSES):
            alone = [(second[k, b] + 0.5) / (every[k] + 0.5 * CLASSES) for k in (0, 1)]
            p = [(counts.get((k, a * CLASSES + b), 0) + PRIOR * alone[k]) / (first[k, a] + PRIOR) for k in (0, 1)]
            out.append(math.floor(1000 * (math.log(p[1]) - math.log(p[0])) + 0.5))
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_DOCS, threshold: int = THRESHOLD) -> DataFrame:
    """(id, assign, access, hex, markov): arrays of spans (start, stop, value) in every whole text.

    Positions count code points, the stop is exclusive. NULL texts count as empty
    and have no span. Rows with a NULL id are scanned, not trained from; rows that
    repeat are scanned each. Spans of ``markov`` never meet one of the others. An
    empty table gives an empty one; other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    ratios = F.expr("array(" + ",".join(map(str, train(docs, rows))) + ")")
    df = base_spans(docs)
    gaps, hits = spans(F.col("text"), RUN, 0)
    df = df.withColumns({"gaps": gaps, "hits": hits}).withColumn("runs", placed("gaps", "hits")).drop("gaps", "hits", "text")
    score = lambda v: F.aggregate(pairs_of(v), F.lit(0), lambda s, p: s + F.get(ratios, p))
    base = F.concat(*[F.col(k[0]) for k in KINDS])
    free = lambda x: ~F.exists(base, lambda y: (y["start"] < x["stop"]) & (x["start"] < y["stop"]))
    added = F.filter("runs", lambda x: (score(x["value"]) >= threshold) & free(x))
    return df.withColumn(ADDED, added).drop("runs").withColumnRenamed("id", id_col)


def listed(*kinds: str) -> Column:
    """kind:start:stop of all spans, by start, then kind as listed."""

    def named(k: int, kind: str) -> Column:
        name = lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["stop"])
        return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), name(x).alias("name")))

    parts = [named(k, kind) for k, kind in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*parts)), lambda x: x["name"]), ",")


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    names = [k[0] for k in KINDS]
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in names],
        F.sha2(listed(*names), 256).alias("base_sha256"), listed(*names, ADDED).alias("spans"),
    )


def _sql_spans(name: str, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    hits, gaps = f"regexp_extract_all(text, '{quoted}', 0)", f"string_split_regex(text, '{quoted}')"
    return f"""{name}_row as (
      select row, unnest(range(1, len(hits) + 1)) as i, hits, gaps, vals
      from (select row, {hits} as hits, {gaps} as gaps, regexp_extract_all(text, '{quoted}', {group}) as vals from docs)),
    {name}_at as (
      select row, vals[i] as value, length(hits[i]) as n,
        coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) as start
      from {name}_row),
    {name}_span as (select row, cast(start as bigint) as start, cast(start + n as bigint) as stop, value from {name}_at where length(value) >= {least})"""


def _sql() -> str:
    each = ",\n".join(_sql_spans(*k) for k in KINDS) + ",\n" + _sql_spans("run", RUN, 0, RUN_LEAST)
    cut = "text"
    for _, pattern, _, _ in KINDS:
        cut = "regexp_replace({}, '{}', ' ', 'g')".format(cut, pattern.replace("'", "''"))
    cls = "case when c between 97 and 122 then c - 97 when c between 65 and 90 then c - 39 when c between 48 and 57 then c + 4 else 62 end"
    base = " union all ".join(f"select row, start, stop, {k} as k, '{name}' as kind, value from {name}_span" for k, (name, *_) in enumerate(KINDS))
    return f"""
    with docs as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
    {each},
    base as ({base}),
    picked as (
      select * from docs where ('0x' || substr(md5(cast(doc_id as varchar)), 1, 7))::bigint
        < {TRAIN_DOCS * (1 << 28)} // (select greatest(1, count(doc_id)) from docs)),
    words as (
      select 1 as random, value as word from base semi join picked using (row)
      union all select 1, sha256(cast(doc_id as varchar)) from picked
      union all select 1, to_base64(unhex(sha256(cast(doc_id as varchar)))) from picked
      union all select 0, unnest(list_filter(regexp_extract_all({cut}, '{WORD}', 0), lambda w: length(w) < {RUN_LEAST})) from picked),
    coded as (select random, list_transform(list_transform(string_split(word, ''), lambda x: ascii(x)), lambda c: {cls}) as c from words where length(word) > 1),
    pairs as (select random, unnest(list_transform(range(1, len(c)), lambda i: c[i] * {CLASSES} + c[i + 1])) as pair from coded),
    counts as (select random, pair, count(*) as n from pairs group by all),
    firsts as (select random, pair // {CLASSES} as a, sum(n) as n from counts group by all),
    seconds as (select random, pair % {CLASSES} as b, sum(n) as n from counts group by all),
    every as (select k as random, coalesce(sum(n), 0) as n from (values (0), (1)) v(k) left join counts on random = k group by k),
    alone as (
      select e.random, b, (coalesce(s.n, 0) + 0.5::double) / (e.n + 0.5::double * {CLASSES}) as p
      from every e cross join (select unnest(range({CLASSES})) as b) left join seconds s using (random, b)),
    chance as (
      select a.random, p.pair, (coalesce(c.n, 0) + {PRIOR} * a.p) / (coalesce(f.n, 0) + {PRIOR}) as p
      from (select unnest(range({CLASSES * CLASSES})) as pair) p join alone a on a.b = p.pair % {CLASSES}
      left join counts c on c.random = a.random and c.pair = p.pair left join firsts f on f.random = a.random and f.a = p.pair // {CLASSES}),
    grid as (
      select pair, floor(1000 * (ln(r.p) - ln(o.p)) + 0.5) as ratio
      from chance r join chance o using (pair) where r.random = 1 and o.random = 0),
    runs as (select row, start, stop, value, row_number() over () as run from run_span),
    run_coded as (select run, list_transform(list_transform(string_split(value, ''), lambda x: ascii(x)), lambda c: {cls}) as c from runs),
    run_pairs as (select run, unnest(list_transform(range(1, len(c)), lambda i: c[i] * {CLASSES} + c[i + 1])) as pair from run_coded),
    scored as (select run, sum(ratio) as score from run_pairs join grid using (pair) group by run),
    added as (
      select r.row, r.start, r.stop, 3 as k, '{ADDED}' as kind from runs r join scored using (run) where score >= {THRESHOLD}
        and not exists (select 1 from base b where b.row = r.row and b.start < r.stop and r.start < b.stop)),
    told as (
      select row, count_if(k = 0) as n_assign, count_if(k = 1) as n_access, count_if(k = 2) as n_hex,
        string_agg(kind || ':' || start || ':' || stop, ',' order by start, k) filter (where k < 3) as base,
        string_agg(kind || ':' || start || ':' || stop, ',' order by start, k) as spans
      from (select row, start, stop, k, kind from base union all select * from added) group by row)
    select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
      sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
    from docs left join told using (row)"""


OP3_SQL = _sql()
