"""Clips of parts' names: a word is a level as long as it is to say, with a pause after the first and the third, which have commas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sound
from ..sources.tables import table

RATE = 1000


def _clips(spark, d):
    w = F.split("p_name", " ")
    level = F.lpad(F.hex((F.col("p_partkey") % 200 + 50).cast("int")), 2, "0")
    unit = F.concat(F.repeat(F.concat(level, F.lit("00")), 40))  # 40 ms
    words = F.transform(w, lambda x, i: F.concat(F.repeat(unit, F.length(x) + 1), F.when(((i == 0) | (i == 2)) & (i < F.size(w) - 1), F.repeat(F.lit("0000"), 200)).otherwise("")))
    data = F.array_join(words, "")
    size = (F.length(data) / 2).cast("int")
    little = lambda n: F.concat(*(F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(4)))
    head = F.concat(F.lit("52494646"), little(size + 36), F.lit("57415645666d7420" "10000000" "01000100" "E8030000" "D0070000" "02001000" "64617461"), little(size))
    text = F.array_join(F.transform(w, lambda x, i: F.concat(x, F.when(((i == 0) | (i == 2)) & (i < F.size(w) - 1), ",").otherwise(""))), " ")
    # a row is small and its clip and the work on it are not: rows are dealt before, so that one file of them is more than one task
    parts = table(spark, d, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return parts.select("p_partkey", text.alias("text"), F.unhex(F.concat(head, data)).alias("content"))


def q6_word_bounds(spark, d):
    found = sound.timed_words(_clips(spark, d), "p_partkey", "content", "text")
    return found.select("p_partkey", F.posexplode("words").alias("k", "w")).select("p_partkey", "k", "w.start", F.round("w.begin_s", 3).alias("begin_s"), F.round("w.end_s", 3).alias("end_s"))


def q1_ready_clips(spark, d):
    made = sound.ready_clips(_clips(spark, d), "p_partkey", "content", "text", speed=1.25, word_gap_s=0.05, mark_pause_s={",": 0.1}, sentence_pause_s=0.3, level_db=-20.0)
    return made.select("p_partkey", F.round("seconds", 3).alias("seconds"), F.size("words").alias("words"), (F.exists("words", lambda w: w["end_s"] <= w["begin_s"]) | (F.col("words")[0]["begin_s"] > 0.001)).alias("broken"))


QUERIES = {f.__name__: f for f in (q6_word_bounds, q1_ready_clips)}

_W = """(SELECT p_partkey, w, len(w) AS n, [CASE WHEN i IN (1, 3) AND i < len(w) THEN 1 ELSE 0 END FOR i IN range(1, len(w) + 1)] AS c FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part))"""
ORACLE_SQL = {
    "q6_word_bounds": f"""SELECT p_partkey, CAST(k - 1 AS INTEGER) AS k, CAST(coalesce(list_sum([length(x) + 1 FOR x IN w[1:k - 1]]), 0) + coalesce(list_sum(c[1:k - 1]), 0) AS INTEGER) AS start,
        round(b, 3) AS begin_s, round(b + 0.04 * (length(w[k]) + 1), 3) AS end_s
        FROM (SELECT *, (0.04 * coalesce(list_sum([length(x) + 1 FOR x IN w[1:k - 1]]), 0) + 0.2 * coalesce(list_sum(c[1:k - 1]), 0))::DOUBLE AS b FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM {_W}))""",
    "q1_ready_clips": f"""SELECT p_partkey, round(((0.04 * list_sum([length(x) + 1 FOR x IN w]) + 0.2 * list_sum(c)) / 1.25 + 0.05 * (n - 1) + 0.1 * list_sum(c) + 0.3)::DOUBLE, 3) AS seconds, CAST(n AS INTEGER) AS words, false AS broken FROM {_W}""",
}
