"""Licences of files: sparse TF-IDF cosine of their lines to templates, then inheritance from the nearest directory.

1. A line is compared with every template by the cosine of TF-IDF vectors over
   words; words outside the templates count in the line's length only. A line
   can reach THRESHOLD only if it holds one of a template's leading terms: the
   others together are shorter than the threshold. Texts and lines without any
   leading term are left out by that, and nothing else is.
2. A file's own licence is its best line at or above THRESHOLD.
3. Licence files, by name or because licence lines are half of their words, speak
   for their directory. A file without a licence of its own takes that of the
   nearest directory above it, found by joining its directory's ancestors.

Only DataFrame functions are used; the templates are constants of this module.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, table, word_count

#: Licence and the wordings by which files name it.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("BSD-3-Clause", "Released under the BSD License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This work is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
)
THRESHOLD = 0.8
LICENCE_NAME = "(^|/)(license|licence|copying|unlicense)[^/]*$"
LINE_END, NOT_WORD = r"\n|(?<=[.!?])\s+", "[^a-z0-9]+"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(NOT_WORD, text.lower()) if w]


def idf() -> tuple[dict[str, float], float]:
    """Inverse document frequency of the templates' words, and that of any other word."""
    df: dict[str, int] = {}
    for _, text in TEMPLATES:
        for w in set(words_of(text)):
            df[w] = df.get(w, 0) + 1
    n = len(TEMPLATES)
    return {w: math.log((1 + n) / (1 + k)) + 1 for w, k in sorted(df.items())}, math.log(1 + n) + 1


def template_weights() -> list[tuple[int, str, str, float]]:
    """(number, licence, word, weight) with each template's weights of length 1."""
    weight, _ = idf()
    out = []
    for k, (name, text) in enumerate(TEMPLATES):
        ws = words_of(text)
        raw = {w: ws.count(w) * weight[w] for w in dict.fromkeys(ws)}
        size = math.sqrt(sum(x * x for x in raw.values()))
        out += [(k, name, w, x / size) for w, x in raw.items()]
    return out


def leading_terms(threshold: float = THRESHOLD) -> list[str]:
    """For each template its longest words, until the others together are shorter than the threshold.

    Any such choice is safe; long words are the ones that other texts rarely hold.
    """
    found = set()
    for k in range(len(TEMPLATES)):
        mine = {w: x for n, _, w, x in template_weights() if n == k}
        rest = 1.0
        for w in sorted(mine, key=lambda w: (len(w), w), reverse=True):
            if math.sqrt(max(rest, 0.0)) < threshold - 1e-9:
                break
            found.add(w)
            rest -= mine[w] ** 2
    return sorted(found)


def leading_pattern(threshold: float = THRESHOLD) -> str:
    return f"(^|[^a-z0-9])({'|'.join(leading_terms(threshold))})($|[^a-z0-9])"


def line_scores(files: DataFrame, threshold: float) -> DataFrame:
    """(id, path, line, n, license, cosine) of the lines of ``files(id, path, text)`` that reach the threshold; n counts the line's words."""
    spark = files.sparkSession
    some = leading_pattern(threshold)
    weight, other = idf()
    weights = spark.createDataFrame([(k, name, w, x, weight[w]) for k, name, w, x in template_weights()], "template int, license string, word string, weight double, idf double")
    idfs = weights.select("word", "idf").distinct()
    lines = (
        files.filter(F.lower("text").rlike(some))
        .select("id", "path", F.posexplode(F.split("text", LINE_END)).alias("line", "part"))
        .select("id", "path", "line", F.lower("part").alias("part")).filter(F.col("part").rlike(some))
    )
    # Rows that repeat with one id and path are one file.
    terms = lines.distinct().select("id", "path", "line", F.explode(F.split("part", NOT_WORD)).alias("word")).filter("word <> ''")
    key = ["id", "path", "line"]
    terms = terms.groupBy(*key, "word").agg(F.count(F.lit(1)).alias("tf"))
    terms = terms.join(F.broadcast(idfs), "word", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(other))).drop("idf")
    size = terms.groupBy(*key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"), F.sum("tf").alias("n"))
    product = terms.join(F.broadcast(weights.drop("idf")), "word").groupBy(*key, "template", "license").agg(F.sum(F.col("x") * F.col("weight")).alias("product"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    both = product.alias("a").join(size.alias("b"), same).select("a.*", "b.size", "b.n")
    scored = both.withColumn("cosine", F.round(F.col("product") / F.col("size"), 6)).filter(F.col("cosine") >= threshold)
    best = F.max_by(F.struct("license", "cosine"), F.struct("cosine", -F.col("template"))).alias("best")
    return scored.groupBy(*key).agg(best, F.first("n").alias("n")).select(*key, "n", "best.*")


def ancestors(path: Column) -> Column:
    """All directories above a path, the nearest last; the root is the empty text."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def license_files(
    files: DataFrame, id_col: str = "id", path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """(id, path, license, score, origin, directory) for every row of ``files``.

    ``origin`` is ``own`` for a licence found in the file, ``directory`` for an
    inherited one with its ``directory``, and NULL without a licence. Ties go to
    the higher score, then the earlier template, then the smaller path. NULL and
    empty texts have no licence of their own; a NULL path is the root. Rows that
    repeat with one id and path count as one file and keep their rows. An empty
    table gives an empty one; other columns are not read.
    """
    ws = Workspace(files.sparkSession, "licenses")
    files = files.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.col(text_col).cast("string").alias("text")
    )
    names = ws.keep(files.select("id", "path", word_count("text").alias("words")), "names")
    found = ws.keep(line_scores(files, threshold), "lines")
    own = found.groupBy("id", "path").agg(
        F.max_by(F.struct("license", F.col("cosine").alias("score")), F.struct("cosine", -F.col("line"))).alias("own"), F.sum("n").alias("told")
    )
    dirs = F.regexp_replace("path", "/?[^/]*$", "")
    same = F.col("f.id").eqNullSafe(F.col("o.id")) & (F.col("f.path") == F.col("o.path"))
    rows = names.withColumn("dir", dirs).alias("f").join(own.alias("o"), same, "left").select("f.*", "own", "told")
    rows = ws.keep(rows, "rows")
    speaks = F.lower("path").rlike(LICENCE_NAME) | (F.col("told") * 2 >= F.col("words"))
    by_dir = rows.filter(F.col("own").isNotNull() & speaks).groupBy("dir", "own").agg(F.min("path").alias("path"))
    ranked = by_dir.groupBy("dir").agg(F.min(F.struct((-F.col("own.score")).alias("s"), "path", "own")).alias("first"))
    ranked = ranked.select(F.col("dir").alias("directory"), F.col("first.own").alias("given"))
    # Directories are far fewer than files; each looks up its own ancestors once.
    seen = rows.select("dir").distinct().withColumn("up", F.concat(ancestors(F.col("dir")), F.array("dir")))
    above = seen.select("dir", F.posexplode(F.array_distinct("up")).alias("depth", "directory"))
    nearest = above.join(ranked, "directory").groupBy("dir").agg(F.max_by(F.struct("directory", "given"), "depth").alias("near"))
    out = rows.join(nearest, "dir", "left")
    mine = F.col("own").isNotNull()
    given = F.col("near").isNotNull() & ~mine
    return out.select(
        F.col("id").alias(id_col), F.col("path").alias(path_col),
        F.when(mine, F.col("own.license")).otherwise(F.col("near.given.license")).alias("license"),
        F.when(mine, F.col("own.score")).otherwise(F.col("near.given.score")).alias("score"),
        F.when(mine, "own").when(given, "directory").alias("origin"),
        F.when(given, F.col("near.directory")).alias("directory"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no path; the query files them as source / hundred of the id / id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string"))
    return license_files(docs.withColumn("path", path), id_col="doc_id")


def _sql() -> str:
    weight, other = idf()
    rows = ", ".join(f"({k}, '{name}', '{w}', {x!r}::double, {weight[w]!r}::double)" for k, name, w, x in template_weights())
    some = leading_pattern()
    return f"""
    with t(template, license, word, weight, idf) as (values {rows}),
    idfs as (select distinct word, idf from t),
    files as (
      select doc_id, text, concat_ws('/', coalesce(source, 'none'), cast(doc_id // 100 as varchar), cast(doc_id as varchar)) as path,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as words
      from documents),
    marked as (select doc_id, regexp_replace(text, '([.!?])[\\t\\n\\x0b\\f\\r ]+', '\\1' || chr(10), 'g') as text from files where regexp_matches(lower(text), '{some}')),
    lines as (select doc_id, unnest(range(len(string_split(text, chr(10))))) as line, lower(unnest(string_split(text, chr(10)))) as part from marked),
    words as (
      select doc_id, line, unnest(string_split_regex(part, '{NOT_WORD}')) as word from lines where regexp_matches(part, '{some}')),
    tf as (select doc_id, line, word, count(*) as tf from words where word <> '' group by all),
    x as (select tf.*, tf.tf * coalesce(idf, {other!r}) as x from tf left join idfs using (word)),
    size as (select doc_id, line, sqrt(sum(x * x)) as size, sum(tf) as n from x group by all),
    cosine as (
      select doc_id, line, template, license, any_value(n) as n, round(sum(x * weight) / any_value(size), 6) as cosine
      from x join t using (word) join size using (doc_id, line) group by all),
    best as (select * from cosine where cosine >= {THRESHOLD} qualify row_number() over (partition by doc_id, line order by cosine desc, template) = 1),
    told as (select doc_id, sum(n) as told from best group by all),
    own as (select doc_id, license, cosine as score from best qualify row_number() over (partition by doc_id order by cosine desc, line) = 1),
    rows as (
      select f.doc_id, path, words, regexp_replace(path, '/?[^/]*$', '') as dir, own.license, own.score, told
      from files f left join own using (doc_id) left join told using (doc_id)),
    given as (
      select dir as directory, license as g_license, score as g_score from rows
      where license is not null and (regexp_matches(lower(path), '{LICENCE_NAME}') or told * 2 >= words)
      qualify row_number() over (partition by dir order by score desc, path) = 1),
    near as (
      select dir, directory, g_license, g_score from (select distinct dir from rows) d join given
        on directory = dir or directory = '' or starts_with(dir, directory || '/')
      qualify row_number() over (partition by dir order by length(directory) desc) = 1)
    select doc_id, path, coalesce(license, g_license) as license, coalesce(score, g_score) as score,
      case when license is not null then 'own' when g_license is not null then 'directory' end as origin,
      case when license is null then directory end as directory
    from rows left join near using (dir)"""


OP2_SQL = _sql()
