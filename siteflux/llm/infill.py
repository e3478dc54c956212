"""Fill-in-middle: cut texts at two random units and move the middle to the end."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteflux.llm.common import text_of, wrapped

SEED, RATE, SUFFIX_FIRST = 42, 50, 80
#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Links of one lane that a link of the lane above spans.
SPAN = 8


class SkipList:
    """A text's units under express lanes.

    A link of the lowest lane passes one unit; one of a higher lane passes ``SPAN`` links of the lane below. Every
    link carries how many units and how many code points it passes, so a rank is reached by going down the lanes
    and adding widths: at most ``SPAN - 1`` links a lane, and a number of lanes that grows with the logarithm of the
    units. No table of running sums over the whole text is kept.
    """

    def __init__(self, points: np.ndarray):
        self.units = len(points)
        self.lanes = [(np.ones(len(points), np.int64), points)]
        while len(self.lanes[-1][0]) > SPAN:
            starts = np.arange(0, len(self.lanes[-1][0]), SPAN)
            self.lanes.append(tuple(np.add.reduceat(width, starts) for width in self.lanes[-1]))

    def reach(self, rank: int) -> int:
        """Code points before the unit of this rank (0 to the number of units)."""
        if not 0 <= rank <= self.units:
            raise IndexError(rank)
        passed = points = at = 0
        for lane, (by_unit, by_point) in enumerate(reversed(self.lanes)):
            at *= SPAN if lane else 1
            while at < len(by_unit) and passed + by_unit[at] <= rank:
                passed, points, at = passed + int(by_unit[at]), points + int(by_point[at]), at + 1
        return points


def unit_points(text: str) -> np.ndarray:
    """Code points of each unit: a word with the white space before it, or white space at the end."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    if len(codes) and space[-1]:
        ends = np.append(ends, len(codes))
    return np.diff(ends, prepend=0)


def _cuts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, first, second in batches:
        rows = []
        for text, one, two in zip(texts, first, second):
            units = SkipList(unit_points(text))
            a, b = sorted((one % (units.units + 1), two % (units.units + 1)))
            start = units.reach(a)
            rows.append((units.units, start, units.reach(b) - start))
        yield pd.DataFrame(rows, columns=["n", "prefix", "middle"])


def fill_in_middle(
    docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS
) -> DataFrame:
    """Texts for infilling: ``doc_id, n, form, prefix_chars, middle_chars, output`` and ``given``, the whole input row.

    A unit is a word with the white space before it, or white space at a text's end; ``n`` counts them. Two ranks
    drawn from a SHA-256 of seed and doc_id cut a text into prefix, middle and suffix. ``rate`` percent of the
    documents are rearranged, of them ``suffix_first`` percent as ``spm`` (suffix, prefix, middle), the others as
    ``psm`` (prefix, suffix, middle). The rest are ``plain``: ``output`` is the text and both lengths are null.

    A null text counts as empty; an empty text and one that holds a mark are plain, so that ``restore`` is exact. A
    null doc_id draws as the word null. Repeated rows get equal results; an empty table gives none. Columns of the
    input stay inside ``given`` and cannot clash. Rows are worked on one by one, whatever their length.
    """
    if len(set(marks)) < 3 or not all(re.fullmatch("<[^<>]+>", m) for m in marks):
        raise ValueError("marks must be three different names in angle brackets")
    cuts = F.pandas_udf(_cuts, "n long, prefix int, middle int")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    h = [F.conv(F.substring("_digest", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    rows = wrapped(docs).select("given", "doc_id", text_of().alias("_text"), digest.alias("_digest"))
    rows = rows.withColumn("_cut", cuts("_text", h[0], h[1]))
    text, p, m = F.col("_text"), F.col("_cut.prefix"), F.col("_cut.middle")
    marked = F.contains(text, F.lit(marks[0])) | F.contains(text, F.lit(marks[1])) | F.contains(text, F.lit(marks[2]))
    plain = (text == "") | marked | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    prefix, middle = F.substring(text, F.lit(1), p), F.substring(text, p + 1, m)
    rest = F.substring(text, p + m + 1, F.length(text))
    head, tail, end = [F.lit(mark) for mark in marks]
    rows = rows.withColumn("form", form)
    moved = F.when(F.col("form") == "plain", text).when(F.col("form") == "spm", F.concat(tail, rest, head, prefix, end, middle))
    return rows.select(
        "doc_id",
        F.col("_cut.n").alias("n"),
        "form",
        F.when(F.col("form") != "plain", p).cast("long").alias("prefix_chars"),
        F.when(F.col("form") != "plain", m).cast("long").alias("middle_chars"),
        moved.otherwise(F.concat(head, prefix, tail, rest, end, middle)).alias("output"),
        "given",
    )


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``fill_in_middle`` turned into ``output``."""
    head, tail, end = marks
    middle, before = F.substring_index(output, end, -1), F.substring_index(output, end, 1)

    def without(part: Column, mark: str) -> Column:
        return F.substring(part, F.lit(len(mark) + 1), F.length(part))

    spm = F.concat(F.substring_index(before, head, -1), middle, without(F.substring_index(before, head, 1), tail))
    psm = F.concat(without(F.substring_index(before, tail, 1), head), middle, F.substring_index(before, tail, -1))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP11_SQL = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
units AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM hashed),
ranks AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM ranks),
made AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
    ELSE '<P>' || p || '<S>' || s || '<M>' || m END AS o FROM parts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(o) AS output_sha256, sha256(t) AS restored_sha256
FROM made
"""
