"""Audit of filters that are applied one after another, for every order they could have.

Each row has a mask: which filters it fails and which marks it bears. For a mask, what happens at
each step of each order is fixed, so it maps to one big integer whose fields hold the outcomes of
all steps (kept, removed, redundant, unique, and removed with each mark). A field takes as many
bytes as the number of rows of its part needs; no sum can reach the next field. The integers of
a part are added, equal masks as one product with their count, and unpacked once.

Rows are counted by part and mask first (combined map-side): a part has at most two to the
number of filters and marks such counts, whatever its share of the rows.

Defined cases: a null part is the part ''; null verdicts and marks count as false; repeated rows
count each; every part has all its steps, zeros included; an empty table has no parts and gives no
rows; columns besides those named are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import fresh, keep, query, table

COUNTS = ["kept", "removed", "redundant", "unique_fails"]
WORDS, VARIED, CAPITALS = 100, 80, 10
SIGNS = re.compile(rb"[#$%&*|]")
CAPS = bytes(range(65, 91))


@lru_cache(maxsize=8)
def orders(filters: int) -> np.ndarray:
    """All orders of the filters, as numbers, in lexicographic order."""
    return np.array(list(permutations(range(filters))), np.int64).reshape(-1, filters)


@lru_cache(maxsize=4096)
def packed(mask: int, filters: int, marks: int, width: int) -> int:
    """The integer of a mask: fields of ``width`` bytes by (count, order, step)."""
    fails = ((mask >> orders(filters)) & 1).astype(bool)
    before = (np.cumsum(fails, axis=1) - fails) > 0
    removed = fails & ~before
    alone = fails & ((mask & ((1 << filters) - 1)).bit_count() == 1)
    counts = [~fails & ~before, removed, fails & before, alone, *(removed & bool(mask >> (filters + m) & 1) for m in range(marks))]
    fields = np.zeros((len(counts) * fails.size, width), np.uint8)
    fields[:, 0] = np.concatenate([c.ravel() for c in counts])
    return int.from_bytes(fields.tobytes(), "little")


def unpacked(total: int, counts: int, filters: int, width: int) -> np.ndarray:
    """Counts by (count, order, step) out of a sum."""
    steps = orders(filters).size
    data = np.frombuffer(total.to_bytes(counts * steps * width, "little"), np.uint8).reshape(-1, width)
    full = np.zeros((len(data), 8), np.uint8)
    full[:, :width] = data
    return full.view("<i8").reshape(counts, -1, filters)


def audit(rows: DataFrame, part: str, filters: dict[str, str], marks: dict[str, str]) -> DataFrame:
    """Counts per part, order and step.

    ``filters`` names the boolean column of failures by letter, in the order in which orders are
    listed; ``marks`` names the boolean column behind each further count of removed rows. All
    orders are listed, so filters should be few (five have 120).
    """
    bits = [*filters.values(), *marks.values()]
    mask = sum((F.when(F.coalesce(F.col(c), F.lit(False)), 1 << i).otherwise(0) for i, c in enumerate(bits)), F.lit(0))
    counted = rows.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.alias("mask")).groupBy("part", "mask").agg(F.count("*").alias("n"))
    letters, k, m = list(filters), len(filters), len(marks)
    names = [*COUNTS, *marks, "shapley"]
    schema = T.StructType([T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType()), T.StructField("filter", T.StringType()),
                           *(T.StructField(n, T.LongType()) for n in names)])

    def tell(group: pa.Table) -> pa.Table:
        n = group["n"].to_pylist()
        width = (sum(n).bit_length() + 7) // 8
        total = sum(count * packed(own, k, m, width) for own, count in zip(group["mask"].to_pylist(), n))
        counts = unpacked(total, len(COUNTS) + m, k, width)
        every = orders(k)
        removed = np.zeros(k, np.int64)
        np.add.at(removed, every, counts[1])
        spelled = ["".join(letters[i] for i in o) for o in every]
        columns = [pa.array(group["part"].to_pylist()[:1] * every.size, pa.string()), pa.array(np.repeat(np.array(spelled, object), k), pa.string()), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(every))),
                   pa.array([letters[i] for i in every.ravel()], pa.string()), *(pa.array(c.ravel()) for c in counts), pa.array(removed[every].ravel())]
        return pa.Table.from_arrays(columns, names=schema.fieldNames())

    return counted.groupBy("part").applyInArrow(tell, schema)


def text_failures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without its text, with failures ``fails_A`` to ``fails_E`` (boolean).

    A: under 100 words; B: distinct words under 80 percent; C: capitals over 10 percent of the code
    points; D: a sign of ``#$%&*|``; E: the same text under a smaller id anywhere (null ids are
    neither smaller nor larger than others). Null texts are empty. Texts are compared by a 256-bit
    hash; of them only the hash travels.
    """
    names = [f"fails_{c}" for c in "ABCDE"]
    rest = [c for c in docs.columns if c != text and c not in names]
    docs = docs.select(*dict.fromkeys([*rest, text]))
    hash_name, least = fresh("text_hash", docs), fresh("least_id", docs)
    schema = T.StructType([*(docs.schema[c] for c in rest), *(T.StructField(n, T.BooleanType()) for n in names[:4]), T.StructField(hash_name, T.BinaryType())])

    def judge(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            n = batch.num_rows
            fails, hashes = np.zeros((4, n), bool), []
            points = pc.fill_null(pc.utf8_length(column.cast(pa.string())), 0).to_numpy(zero_copy_only=False)
            for i, t in enumerate(column.cast(pa.binary()).to_pylist()):
                t = t or b""
                words = t.split()
                fails[0, i] = len(words) < WORDS
                fails[1, i] = 100 * len(set(words)) < VARIED * len(words)
                fails[2, i] = 100 * (len(t) - len(t.translate(None, CAPS))) > CAPITALS * points[i]
                fails[3, i] = SIGNS.search(t) is not None
                hashes.append(hashlib.sha256(t).digest())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in rest), *(pa.array(f) for f in fails), pa.array(hashes, pa.binary())], names=schema.fieldNames())

    judged = keep(docs.mapInArrow(judge, schema))
    seen = judged.filter(F.col(key).isNotNull()).groupBy(hash_name).agg(F.min(key).alias(least), F.count("*").alias("n"))
    first = keep(seen.filter("n > 1").select(hash_name, least))
    return judged.join(first, hash_name, "left").withColumn("fails_E", F.coalesce(F.col(key) > F.col(least), F.lit(False))).select(*rest, *names)


def marked(rows: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows`` with ``good`` and ``toxic`` from labels (true if any label of the id says so)."""
    own = keep(labels.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")))
    return rows.drop("good", "toxic").join(own, key, "left")


SQL_OP13 = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
f AS (SELECT part, doc_id, concat(CASE WHEN len(words) < 100 THEN 'A' END, CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' END,
  CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
  CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' END) AS fails FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT p.c || q.c || r.c || s.c || t.c AS o FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.c, q.c, r.c, s.c, t.c])) = 5),
k AS (SELECT o, i AS step, substr(o, i, 1) AS c, substr(o, 1, i - 1) AS earlier FROM o, unnest(range(1, 6)) AS r(i)),
z AS (SELECT part, o, step, c, n, good, toxic, fails, contains(fails, c) AS fail, step > 1 AND len(list_intersect(string_split(fails, ''), string_split(earlier, ''))) > 0 AND fails <> '' AS gone FROM m, k),
g AS (SELECT part, o AS filter_order, step::INT AS step, c AS filter, sum(CASE WHEN NOT fail AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fail AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN fail AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails = c THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN fail AND NOT gone AND good = 1 THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN fail AND NOT gone AND toxic = 1 THEN n ELSE 0 END)::BIGINT AS toxic_lost FROM z GROUP BY ALL)
SELECT *, sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM g
"""


@query("op13_filter_audit", SQL_OP13)
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = marked(text_failures(docs), table(spark, sf_dir, "labels"))
    return audit(rows, "lang", {c: f"fails_{c}" for c in "ABCDE"}, {"good_lost": "good", "toxic_lost": "toxic"})
