"""Chat formatting for preference training, in DataFrame functions only.

Of a pair of conversations, chosen and rejected, the longest common prefix of turns (same role and
text, in turn order) is rendered once as the prompt; each side's remaining turns are rendered as its
completion, cut into segments with a mask: 1 for assistant turns, which are learned, 0 for others.

Conversations are paired by number: conv_id 2p is chosen, 2p + 1 rejected. So no group is larger
than two conversations, whatever the texts share.

Defined cases: a null role or text renders as empty and equals another null only; turns with the
same number are ordered by role and text; repeated rows are repeated turns; null conv_id or turn is
ignored; a conversation without its partner gives no row; if one side is a prefix of the other its
completion is empty; the template is <|role|>, a line break, the text, <|end|> and a line break.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _render(turns: F.Column) -> F.Column:
    one = F.transform(turns, lambda t: F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("")), F.lit("|>\n"), F.coalesce(t["text"], F.lit("")), F.lit("<|end|>\n")))
    return F.array_join(one, "")


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) with the turns in order."""
    rows = rows.where("conv_id is not null and turn is not null")
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pairs (pair_id, c, r: arrays of turns): pair_id, n_prompt, prompt, and for each side its
    completion, segments and mask."""
    differs = F.expr("filter(sequence(1, greatest(1, least(size(c), size(r)))), i -> i > least(size(c), size(r)) or not (c[i - 1].role <=> r[i - 1].role and c[i - 1].text <=> r[i - 1].text))")
    pairs = pairs.select("*", F.coalesce(F.get(differs, F.lit(0)) - 1, F.least(F.size("c"), F.size("r"))).alias("n"))
    out = [F.col("pair_id"), F.col("n").alias("n_prompt"), _render(F.expr("slice(c, 1, n)")).alias("prompt")]
    for name, side in (("chosen", "c"), ("rejected", "r")):
        rest = F.expr(f"slice({side}, n + 1, size({side}))")
        out += [
            _render(rest).alias(name),
            F.transform(rest, lambda t: F.when(t["role"] == "assistant", 1).otherwise(0)).alias(f"{name}_mask"),
            F.transform(rest, lambda t: F.length(F.coalesce(t["role"], F.lit(""))) + F.length(F.coalesce(t["text"], F.lit(""))) + 13).alias(f"{name}_lengths"),
        ]
    return pairs.select(*out)


def pair_by_number(rows: DataFrame) -> DataFrame:
    """(pair_id, c, r) from the conversations of two neighbouring numbers."""
    all_ = conversations(rows).select("turns", F.expr("floor(conv_id / 2)").alias("pair_id"), F.pmod("conv_id", F.lit(2)).alias("side"))
    return all_.groupBy("pair_id").agg(F.first(F.when(F.col("side") == 0, F.col("turns")), True).alias("c"), F.first(F.when(F.col("side") == 1, F.col("turns")), True).alias("r")).where("c is not null and r is not null")


def formatted(rows: DataFrame) -> DataFrame:
    """The query's form: masks and segment lengths as text."""
    out = format_pairs(pair_by_number(rows))
    as_text = {f"{s}_{k}": F.concat_ws(",", F.transform(f"{s}_{k}", lambda x: x.cast("string"))) for s in ("chosen", "rejected") for k in ("mask", "lengths")}
    return out.withColumns(as_text)


_SIDE = """
  coalesce((SELECT string_agg('<|' || coalesce(x.role, '') || '|>' || chr(10) || coalesce(x.text, '') || '<|end|>' || chr(10), '' ORDER BY x.i) FROM t x WHERE x.conv_id = p.{id} AND x.i > p.n), '') AS {side},
  coalesce((SELECT string_agg(CASE WHEN x.role = 'assistant' THEN '1' ELSE '0' END, ',' ORDER BY x.i) FROM t x WHERE x.conv_id = p.{id} AND x.i > p.n), '') AS {side}_mask,
  coalesce((SELECT string_agg((length(coalesce(x.role, '')) + length(coalesce(x.text, '')) + 13)::VARCHAR, ',' ORDER BY x.i) FROM t x WHERE x.conv_id = p.{id} AND x.i > p.n), '') AS {side}_lengths"""
ORACLE = f"""
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS i
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT conv_id, max(i) AS k FROM t GROUP BY conv_id),
b AS (SELECT a.conv_id AS cid, z.conv_id AS rid, least(a.k, z.k) AS k FROM c a JOIN c z ON z.conv_id = a.conv_id + 1 WHERE a.conv_id % 2 = 0),
p AS (SELECT cid, rid, coalesce((SELECT min(x.i) - 1 FROM t x JOIN t y ON y.i = x.i AND y.conv_id = b.rid
    WHERE x.conv_id = b.cid AND (x.role IS DISTINCT FROM y.role OR x.text IS DISTINCT FROM y.text)), k) AS n FROM b)
SELECT cid // 2 AS pair_id, n::INT AS n_prompt,
  coalesce((SELECT string_agg('<|' || coalesce(x.role, '') || '|>' || chr(10) || coalesce(x.text, '') || '<|end|>' || chr(10), '' ORDER BY x.i) FROM t x WHERE x.conv_id = p.cid AND x.i <= p.n), '') AS prompt,
  {_SIDE.format(id="cid", side="chosen")},
  {_SIDE.format(id="rid", side="rejected")}
FROM p
"""
