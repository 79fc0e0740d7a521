"""Repair of conversation structure at the least cost, by a higher-order fold over each conversation's turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import own, table

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: What may follow which role's initial; a conversation is empty or ``s?(ua)+``.
_LEGAL = ("su", "ua", "au")
_READ = ("conv_id", "turn", "role", "text")
_WORDLESS = r"\A[\x20\x09-\x0D]*\z"
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"

# A script has one letter an edit: D deletes a row, K keeps it, R and S make it the user's and the assistant's, I and J
# insert one of either. At one place of two scripts that are alike before, the role to come is the same, so scripts
# sort as their edits' initials do.


def _step(rest: Column, cost: Column | int, letter: str) -> Column:
    return F.struct((rest["cost"] + cost).cast("long").alias("cost"), F.concat(F.lit(letter), rest["script"]).alias("script"))


def _with_insertions(start: Column, system: Column, user: Column, assistant: Column) -> Column:
    """The best that follows each of the four states if rows may be inserted first."""
    after_user = F.least(user, _step(assistant, INSERT, "J"))
    return F.struct(
        F.least(start, _step(after_user, INSERT, "I")).alias("start"),
        F.least(system, _step(after_user, INSERT, "I")).alias("system"),
        after_user.alias("user"),
        F.least(assistant, _step(user, INSERT, "I")).alias("assistant"),
    )


def _before(rest: Column, turn: Column) -> Column:
    """What is best from a turn on, for each state before it, given what is best after it."""

    def edit(state: str, to: str, letter: str) -> list[Column]:
        whole = ~turn["required"]
        late = F.when(turn["truncated"], F.lit(TRUNCATED)).otherwise(F.lit(0))
        kept = [F.when(whole & (turn["initial"] == to[0]), _step(rest[to], late, "K"))]
        if state == "start":
            kept.append(F.when(whole & (turn["initial"] == "s"), _step(rest["system"], late, "K")))
        return [_step(rest[state], DELETE, "D"), *kept, F.when(whole, _step(rest[to], late + REROLE, letter))]

    return _with_insertions(
        F.least(*edit("start", "user", "R")),
        F.least(*edit("system", "user", "R")),
        F.least(*edit("user", "assistant", "S")),
        F.least(*edit("assistant", "user", "R")),
    )


def repair_conversations(conversations: DataFrame, lost: str | None = None) -> DataFrame:
    """The cheapest edits that make each conversation's roles read ``(s?(ua)+)?`` by their initials.

    Rows are taken by turn, nulls first, ties by role and text. A row is blank if its text has no word, else
    duplicate if an earlier one of the conversation has its role and text, else truncated if the last character of its
    last word isn't one of ``.!?``. Blank and duplicate rows must go.
    The fold runs from the last turn to the first, as what is put before two scripts keeps their order, and what is put behind
    them needn't; so of all cheapest edits the ASCII-least initials are found.

    Returns a row for each conv_id: gaps, blank, duplicate, truncated, illegal (longs), cost, audit (the edits' initials) and
    repaired, an array of (role, text). Rows where the column ``lost`` holds are known to be missing: they count for nothing
    but that their conv_id is returned. Null roles and texts are read as one space, null turns come first and don't
    count for gaps, rows with a null conv_id are one conversation. A row whose role is empty or of another initial than
    s, u or a can't be kept as it is. Repeated rows are duplicates. An empty table gives no rows; other columns are
    ignored, whatever their names. One shuffle, by conv_id: a conversation is gathered whole, as its repaired form is one value,
    and scripts grow with it, so the fold's work is quadratic in the turns of one conversation (100,000 turns
    copy about 20 GB of letters).
    """
    gone = F.coalesce(F.col(lost), F.lit(False)) if lost else F.lit(False)
    rows = own(conversations, *_READ, *([lost] if lost else [])).select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), gone.alias("gone"))
    in_turn = Window.partitionBy("conv_id").orderBy(F.col("gone").desc(), F.col("turn").asc_nulls_first(), "role", "text")
    alike = Window.partitionBy("conv_id", "role", "text").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("at", F.row_number().over(in_turn)).withColumn("initial", F.substring("role", 1, 1))
    before = F.lag(F.when(~F.col("gone"), F.col("initial"))).over(in_turn)  # null for the first row that is there
    rows = rows.withColumn("illegal", ~F.concat(before, "initial").isin(*_LEGAL))
    rows = rows.withColumn("again", F.count(F.when(~F.col("gone"), 1)).over(alike) > 1)
    rows = rows.withColumn("blank", F.col("text").rlike(_WORDLESS))
    rows = rows.withColumn("duplicate", ~F.col("blank") & F.col("again"))
    rows = rows.withColumn("truncated", ~F.col("blank") & ~F.col("again") & ~F.col("text").rlike(_ENDED))

    there = ~F.col("gone")
    total = lambda name: F.count_if(there & F.col(name)).alias(name)
    turn = F.struct("at", (F.col("blank") | F.col("duplicate")).alias("required"), "truncated", "initial", "role", "text")
    last, first = (f(F.when(there, F.col("turn"))) for f in (F.max, F.min))
    span = F.coalesce(last - first + 1, F.lit(0))
    by_conversation = rows.groupBy("conv_id").agg(
        span.cast("long").alias("span"),
        F.array_sort(F.collect_list(F.when(there, turn))).alias("turns"),
        F.size(F.collect_set(F.when(there, F.col("turn")))).alias("distinct_turns"),
        *(total(name) for name in ("blank", "duplicate", "truncated", "illegal")),
    )
    ends = F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("script"))
    no_end = F.struct(F.lit(1 << 40).cast("long").alias("cost"), F.lit("").alias("script"))
    best = F.aggregate(F.reverse("turns"), _with_insertions(ends, no_end, no_end, ends), _before)["start"]
    scripts = by_conversation.withColumn("best", best)

    # each row's own letter with the rows inserted before it, then what is inserted last
    scripts = scripts.withColumn("letters", F.regexp_extract_all(F.col("best.script"), F.lit("[IJ]*[DKRS]"), F.lit(0)))
    inserted = lambda letters: F.transform(
        F.filter(F.split(letters, ""), lambda x: x.isin("I", "J")),
        lambda x: F.struct(F.when(x == "I", F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit("").alias("text")),
    )

    def edited(row: Column, letters: Column) -> Column:
        letter = F.right(letters, F.lit(1))
        role = F.when(letter == "K", row["role"]).when(letter == "R", F.lit("user")).otherwise(F.lit("assistant"))
        own = F.filter(F.array(F.struct(role.alias("role"), row["text"].alias("text"))), lambda _: letter != "D")
        return F.concat(inserted(letters), own)

    tail = F.regexp_extract("best.script", "[IJ]*$", 0)
    repaired = F.concat(F.flatten(F.zip_with("turns", "letters", edited)), inserted(tail))
    return scripts.select(
        "conv_id",
        (F.col("span") - F.col("distinct_turns")).cast("long").alias("gaps"),
        *(F.col(name).cast("long").alias(name) for name in ("blank", "duplicate", "truncated", "illegal")),
        F.col("best.cost").alias("cost"),
        F.translate("best.script", "JS", "IR").alias("audit"),
        repaired.alias("repaired"),
    )


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults of known kinds, told by a hash of ``conv_id:turn``; ``lost`` marks those that are dropped."""
    spaced = own(conversations, *_READ).select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(name.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return spaced.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("lost"), F.explode(copies).alias("copy")).drop("copy")


def op12_repair_conversations(spark, sf_dir):
    found = repair_conversations(damage(table(spark, sf_dir, "conversations")), "lost")
    lines = F.transform("repaired", lambda row: F.concat(row["role"], F.lit(":"), row["text"]))
    return found.select(*(c for c in found.columns if c != "repaired"), F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))


# crc32 bit by bit; then the fold as a recursion over the turns from the last to the first
OP12_SQL = r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations),
hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(name, ''),
              lambda x: [(ascii(x) + 256)::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT]))),
            lambda c, b: xor(xor(c, CASE WHEN b > 0 THEN b - 256 ELSE 0 END) >> 1,
                             CASE WHEN xor(c, CASE WHEN b > 0 THEN b - 256 ELSE 0 END) & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)),
            4294967295::UBIGINT) % 20 AS kind
  FROM named),
rows_ AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, kind
  FROM hashed WHERE kind <> 0),
there AS (SELECT conv_id, turn, role, text FROM rows_ UNION ALL SELECT conv_id, turn, role, text FROM rows_ WHERE kind = 3),
seen AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n, substr(role, 1, 1) AS initial,
         lag(substr(role, 1, 1)) OVER w AS previous,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS ended
  FROM there WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
turns AS (
  SELECT *, blank OR again AS required, CASE WHEN ended THEN 0 ELSE 5 END AS late
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again FROM seen)),
fold AS (
  SELECT conv_id, max(k) + 1 AS k, 0 AS c0, '' AS a0, '' AS r0, 10 AS c1, 'II' AS a1, e'user:\nassistant:\n' AS r1,
         5 AS c2, 'I' AS a2, e'assistant:\n' AS r2, 0 AS c3, '' AS a3, '' AS r3
  FROM turns GROUP BY conv_id
  UNION ALL
  SELECT conv_id, k, least(e0, i0).c, least(e0, i0).a, least(e0, i0).r, least(e1, i0).c, least(e1, i0).a, least(e1, i0).r,
         b2.c, b2.a, b2.r, least(e3, i3).c, least(e3, i3).a, least(e3, i3).r
  FROM (
    SELECT *, {'c': b2.c + 5, 'a': 'I' || b2.a, 'r': e'user:\n' || b2.r} AS i0, {'c': e2.c + 5, 'a': 'I' || e2.a, 'r': e'user:\n' || e2.r} AS i3
    FROM (
      SELECT *, least(e2, {'c': e3.c + 5, 'a': 'I' || e3.a, 'r': e'assistant:\n' || e3.r}) AS b2
      FROM (
        SELECT conv_id, k,
               least({'c': f.c0 + 2, 'a': 'D' || f.a0, 'r': f.r0},
                     {'c': f.c2 + u, 'a': ul || f.a2, 'r': ur || f.r2},
                     {'c': f.c1 + s, 'a': 'K' || f.a1, 'r': role || ':' || text || e'\n' || f.r1}) AS e0,
               least({'c': f.c1 + 2, 'a': 'D' || f.a1, 'r': f.r1}, {'c': f.c2 + u, 'a': ul || f.a2, 'r': ur || f.r2}) AS e1,
               least({'c': f.c2 + 2, 'a': 'D' || f.a2, 'r': f.r2}, {'c': f.c3 + a, 'a': al || f.a3, 'r': ar || f.r3}) AS e2,
               least({'c': f.c3 + 2, 'a': 'D' || f.a3, 'r': f.r3}, {'c': f.c2 + u, 'a': ul || f.a2, 'r': ur || f.r2}) AS e3
        FROM (
          SELECT *, CASE WHEN required THEN 1000000 WHEN initial = 'u' THEN late ELSE late + 1 END AS u,
                 CASE WHEN required THEN 1000000 WHEN initial = 'a' THEN late ELSE late + 1 END AS a,
                 CASE WHEN required OR initial <> 's' THEN 1000000 ELSE late END AS s,
                 CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END AS ul, CASE WHEN initial = 'a' THEN 'K' ELSE 'R' END AS al,
                 CASE WHEN initial = 'u' THEN role ELSE 'user' END || ':' || text || e'\n' AS ur,
                 CASE WHEN initial = 'a' THEN role ELSE 'assistant' END || ':' || text || e'\n' AS ar
          FROM (SELECT f AS f, t.* FROM fold f JOIN turns t ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.k = f.k - 1)))))),
summed AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1, 0) - count(DISTINCT turn) AS gaps, count_if(blank) AS blank,
         count_if(NOT blank AND again) AS duplicate, count_if(NOT blank AND NOT again AND NOT ended) AS truncated,
         count_if(previous || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(c0, 0) AS BIGINT) AS cost, coalesce(a0, '') AS audit,
       sha256(coalesce(left(r0, length(r0) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN summed s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN fold f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.k = 1
"""
