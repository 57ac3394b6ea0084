"""Repair of conversations at the least cost, as a higher-order fold in Spark SQL.

A conversation's rows, by turn, are to have roles whose initials read (s?(ua)+)?.
Keeping a row costs nothing, giving it the role of user or assistant 2, deleting
it 3, an inserted row 2, and an undeleted truncated row 1 more; blank and
duplicate rows must go. What a row's edit leads to depends on the rows before it
only by the last role kept: nothing yet, s, u or a. So a fold over the rows carries
four structs (cost, audit), one for each, and `least` takes the cheapest way into
each, of equal ones that whose audit is least. Two audits for the same rows are
never one the beginning of the other at the same cost, so what is least for a part
stays so for the whole; and inserting before a deleted row is never least, as D
comes before I.

No conversation is gathered row by row. Rows that are alike are counted before
they are shuffled; rows are range-sorted over all conversations, which gives each
its place; and a conversation is cut wherever a slice of ROWS places ends. Flags
come from windows over slices (a row's neighbour, the first of its kind), the first
of a kind over all slices from a grouped minimum, joined by place. A slice that is
a conversation's first is folded from its start, the others from each of the four
states, and a conversation's slices are then put together in order, one row for
each slice. Texts stay out of this; they meet the audits slice by slice at the end.
What one task must hold is what one row of the result does: an audit and a
repaired text, of 2 GB at most.

Defined results: a null role or text is one space, as is a null id or turn where
it is hashed; rows with a null conv_id are one conversation; null turns come
first; rows of one turn that differ are taken by role, then by text; repeated rows
stand together and are duplicates but for the first; very long texts are shuffled
as any other; conversations that lose all rows, and an empty table, give what no
rows give; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, table, written
from .op11_line_runs import SPACE
from .op13_importance import CRC_SQL, crc32_sql

REROLE, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1
#: Places of a slice, a power of two.
ROWS = 256
#: Range keys take so much of a role and a text; equal beginnings stay together and are sorted whole.
BEGINNING = 64
LEGAL = ("su", "ua", "au")
STATES = ("o", "s", "u", "a")
NEVER = 10**15


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows of the table with faults put in by the hash of id and turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    x = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    said = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return x.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), said.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def placed(rows: DataFrame) -> DataFrame:
    """Distinct rows (conv_id, turn, role, text), how many of each, and their place in the order of all conversations; slice."""
    x = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("long").alias("copies"))
    head = F.when(F.length("role") <= BEGINNING, F.left("text", F.lit(BEGINNING))).otherwise("")
    ends = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn")]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = x.repartitionByRange(n, *ends, F.asc(F.left("role", F.lit(BEGINNING))), F.asc(head)).sortWithinPartitions(*ends, "role", "text")
    x = x.withColumn("place", F.monotonically_increasing_id())
    return x.withColumn("slice", F.shiftright("place", ROWS.bit_length() - 1))


def flagged(rows: DataFrame) -> DataFrame:
    """Placed rows without their texts: initial, blank, duplicate, truncated, illegal, head (of its conversation)."""
    bare = F.btrim("text", F.lit(SPACE))
    kind = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    x = rows.select("conv_id", "slice", "place", "turn", "copies", F.left("role", F.lit(1)).alias("initial"), kind.alias("kind"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open"))
    here = Window.partitionBy("conv_id", "slice").orderBy("place")
    x = x.withColumn("before", F.lag("initial").over(here)).withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "slice", "kind").orderBy("place")))
    x = written(x, "turns-flags")
    # the first of its kind, and of its conversation: joined by place, of which every row has its own
    firsts = x.where("nth = 1").groupBy("conv_id", "kind").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    heads = x.groupBy("conv_id").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("head"))
    y = x.join(firsts, "place", "left").join(heads, "place", "left")
    repeated = F.col("first").isNull()
    pair = F.concat("before", "initial")
    return y.select(
        "conv_id", "slice", "place", "turn", "copies", "initial", F.col("head").isNotNull().alias("head"), "blank",
        (~F.col("blank") & repeated).alias("duplicate"), (~F.col("blank") & ~repeated & F.col("open")).alias("truncated"),
        F.coalesce(~pair.isin(*LEGAL), F.lit(False)).alias("illegal"),
    )


def way(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def and_(state: Column, letters: str | Column, cost: int | Column) -> Column:
    """A way with more letters and cost."""
    return way(state["cost"] + cost, F.concat(state["audit"], F.lit(letters) if isinstance(letters, str) else letters))


def step(at: Column, row: Column) -> Column:
    """The four ways after a row (initial, gone, open, copies). Each row's letters end in |, and
    copies of it, which must go, follow it at once."""
    lost = F.concat(F.repeat(F.lit("D"), (row["copies"] - 1).cast("int")), F.lit("|"))
    dear = DELETE * (row["copies"] - 1)
    deleted = {k: and_(at[k], F.concat(F.lit("D"), lost), DELETE + dear) for k in STATES}

    def kept(before: Column, initial: str) -> Column:
        same = row["initial"] == initial
        letter, cost = F.when(same, F.lit("K")).otherwise(F.lit("R")), F.when(same, F.lit(0)).otherwise(F.lit(REROLE))
        return and_(before, F.concat(letter, lost), cost + dear + F.when(row["open"], CUT_SHORT).otherwise(0))

    to_user = F.least(at["o"], at["s"], at["a"], and_(at["u"], "I", INSERT))
    to_assistant = F.least(at["u"], *[and_(at[k], "I", INSERT) for k in ("o", "s", "a")])
    system = F.when(row["initial"] == "s", F.least(deleted["s"], kept(at["o"], "s"))).otherwise(deleted["s"])
    after = [deleted["o"], system, F.least(deleted["u"], kept(to_user, "u")), F.least(deleted["a"], kept(to_assistant, "a"))]
    gone = [deleted[k] for k in STATES]
    return F.when(row["gone"], F.struct(*[x.alias(k) for x, k in zip(gone, STATES)])).otherwise(F.struct(*[x.alias(k) for x, k in zip(after, STATES)]))


def start(state: str) -> Column:
    return F.struct(*[way(F.lit(0 if k == state else NEVER), F.lit("")).alias(k) for k in STATES])


def folded(flags: DataFrame) -> DataFrame:
    """A row for each conversation's slice: counts of faults, its ends, and moves: the ways through it
    from the start where it is the conversation's first, else from each of the four states."""
    gone = F.col("blank") | F.col("duplicate")
    turn = F.struct("place", "initial", gone.alias("gone"), F.col("truncated").alias("open"), "copies", "turn")
    n = lambda c: F.sum(c).cast("long")
    of = lambda flag, then, otherwise=0: F.when(F.col(flag), then).otherwise(otherwise)
    again = F.col("copies") - 1
    x = flags.groupBy("conv_id", "slice").agg(
        F.sort_array(F.collect_list(turn)).alias("turns"), F.max("head").alias("head"),
        n(of("blank", F.col("copies"))).alias("blank"), n(F.when(F.col("blank"), 0).otherwise(again + of("duplicate", 1))).alias("duplicate"),
        n(of("truncated", 1)).alias("truncated"), n(again + of("illegal", 1)).alias("illegal"),
    )
    starts = F.when(F.col("head"), F.array(start("o"))).otherwise(F.array(*[start(k) for k in STATES]))
    moves = F.transform(starts, lambda v: F.aggregate("turns", v, step))
    first, last = F.element_at("turns", 1), F.element_at("turns", -1)
    turns = F.array_distinct(F.filter(F.col("turns.turn"), lambda t: t.isNotNull()))
    return x.select(
        "conv_id", "slice", "blank", "duplicate", "truncated", "illegal", moves.alias("moves"), F.size(turns).cast("long").alias("n_turns"), F.array_min(turns).alias("low"), F.array_max(turns).alias("high"),
        first["turn"].alias("first_turn"), last["turn"].alias("last_turn"), first["initial"].alias("first_initial"), last["initial"].alias("last_initial"),
    )


def together(slices: DataFrame) -> DataFrame:
    """A row for each conversation: gaps, counts of faults, cost, slices and audits (in order; one more for rows inserted at the end)."""
    part = F.struct("slice", "moves", "first_turn", "last_turn", "first_initial", "last_initial")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "n_turns")]
    x = slices.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("parts"), *sums, F.min("low").alias("low"), F.max("high").alias("high"))

    def through(at: Column, part: Column) -> Column:
        moves = part["moves"]
        join = lambda w, m: way(w["cost"] + m["cost"], F.concat(w["audit"], F.array(m["audit"])))
        one = F.struct(*[join(at["o"], F.element_at(moves, 1)[k]).alias(k) for k in STATES])
        every = F.struct(*[F.least(*[join(at[j], F.get(moves, F.lit(i))[k]) for i, j in enumerate(STATES)]).alias(k) for k in STATES])
        return F.when(F.size(moves) == 1, one).otherwise(every)

    none = F.array().cast("array<string>")
    begin = F.struct(*[way(F.lit(0 if k == "o" else NEVER), none).alias(k) for k in STATES])
    more = lambda w, letters: way(w["cost"] + INSERT * len(letters), F.concat(w["audit"], F.array(F.lit(letters))))
    best = F.aggregate("parts", begin, through, lambda at: F.least(at["o"], at["a"], more(at["u"], "I"), more(at["s"], "II")))
    # neighbours on both sides of a cut
    seams = F.zip_with(F.slice("parts", 1, F.size("parts") - 1), F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), lambda a, b: F.struct((~F.concat(a["last_initial"], b["first_initial"]).isin(*LEGAL)).cast("long").alias("illegal"), F.coalesce((a["last_turn"] == b["first_turn"]).cast("long"), F.lit(0)).alias("same")))
    total = lambda c, f: F.aggregate(c, F.lit(0).cast("long"), lambda a, s: a + s[f])
    x = x.withColumn("best", best).withColumn("seams", F.when(F.size("parts") > 1, seams))
    seam = lambda f: F.coalesce(total("seams", f), F.lit(0))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - (F.col("n_turns") - seam("same")), F.lit(0))
    return x.select("conv_id", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + seam("illegal")).alias("illegal"), F.col("best.cost").alias("cost"), F.col("parts.slice").alias("slices"), F.col("best.audit").alias("audits"))


def role_of(nth: Column) -> Column:
    """The role of the nth row of (ua)+, from 0."""
    return F.when(nth % 2 == 0, F.lit("user")).otherwise(F.lit("assistant"))


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, repaired: the kept and inserted rows of each conversation, role:text, joined by line feeds."""
    stays = lambda c: F.length(F.translate(c, "D|", "")).cast("long")
    n_all = F.aggregate("audits", F.lit(0).cast("long"), lambda a, s: a + stays(s))
    # an odd number of rows begins with s
    p = plans.select("conv_id", (n_all % 2).alias("system"), F.posexplode("audits").alias("i", "audit"), F.col("slices").alias("slices"))
    p = p.select("conv_id", "system", "i", "audit", F.get("slices", F.col("i")).alias("slice"))
    before = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("nth", F.coalesce(F.sum(stays(F.col("audit"))).over(before), F.lit(0)) - F.col("system"))
    tail = p.where("slice is null").select("conv_id", "i", F.array_join(F.transform(F.sequence(F.lit(0), F.length("audit") - 1), lambda k: F.concat(role_of(F.col("nth") + k), F.lit(":"))), "\n").alias("text"))
    texts = rows.groupBy(F.col("conv_id").alias("_conv"), F.col("slice").alias("_slice")).agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    x = p.where("slice is not null").join(texts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("slice") == F.col("_slice")))
    x = x.select("conv_id", "i", "nth", F.zip_with("turns", F.split("audit", r"\|"), lambda t, letters: F.struct(t["role"].alias("role"), t["text"].alias("text"), letters.alias("letters"))).alias("turns"))

    def put(at: Column, turn: Column) -> Column:
        inserted = F.startswith(turn["letters"], F.lit("I"))
        here = at["nth"] + F.when(inserted, 1).otherwise(0)
        letter = F.substring(turn["letters"], F.when(inserted, 2).otherwise(1), F.lit(1))
        new = F.when(inserted, F.array(F.concat(role_of(at["nth"]), F.lit(":")))).otherwise(F.array().cast("array<string>"))
        own = F.when(letter == "K", F.array(F.concat(turn["role"], F.lit(":"), turn["text"]))).when(letter == "R", F.array(F.concat(role_of(here), F.lit(":"), turn["text"]))).otherwise(F.array().cast("array<string>"))
        return F.struct((here + F.when(letter.isin("K", "R"), 1).otherwise(0)).cast("long").alias("nth"), F.concat(at["out"], new, own).alias("out"))

    begin = F.struct(F.col("nth").cast("long").alias("nth"), F.array().cast("array<string>").alias("out"))
    out = F.aggregate(F.filter("turns", lambda t: t["role"].isNotNull()), begin, put, lambda at: at["out"])
    x = x.withColumn("out", out).where(F.size("out") > 0).select("conv_id", "i", F.array_join("out", "\n").alias("text"))
    whole = x.unionByName(tail).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("i", "text"))).alias("parts"))
    return whole.select("conv_id", F.array_join("parts.text", "\n").alias("repaired"))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (conv_id, turn, role, text, copies; nulls in conv_id and turn only): (conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, slices, audits, audit; conv_id, repaired). A repair without rows is missing."""
    own = written(placed(rows), "turns")
    slices = written(folded(flagged(own)), "turns-slices")
    plans = written(together(slices), "turns-plans")
    discard(slices)
    plans = plans.withColumn("audit", F.translate(F.array_join("audits", ""), "|", ""))
    return plans, repaired(own, plans)


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by the hash of id and turn, and what repairs them at the least cost."""
    rows = table(spark, sf_dir, "conversations")
    plans, texts = repair(damaged(rows))
    same = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    every = rows.select("conv_id").distinct().alias("c")
    x = every.join(plans.alias("p"), same("c", "p"), "left").join(texts.alias("t"), same("c", "t"), "left")
    counts = [F.coalesce(f"p.{c}", F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return x.select("c.conv_id", *counts, F.coalesce("p.audit", F.lit("")).alias("audit"), F.sha2(F.coalesce("t.repaired", F.lit("")).cast("binary"), 256).alias("repaired_sha256"))


def oracle() -> str:
    """The same by a recursive walk over each conversation's rows, one at a time."""
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    add = lambda w, letter, cost: f"{{'c': {w}.c + {cost}, 'p': {w}.p || {letter}, 't': {w}.t}}"
    least = lambda *w: f"list_sort([{', '.join(w)}])[1]"
    said = lambda w, letter, cost, role: f"{{'c': {w}.c + {cost}, 'p': {w}.p || {letter}, 't': list_append({w}.t, {role})}}"
    put = lambda w, role: said(w, "'I'", 2, f"'{role}:'")
    keep = lambda w, initial, role: said(w, f"CASE WHEN l.initial = '{initial}' THEN 'K' ELSE 'R' END", f"CASE WHEN l.initial = '{initial}' THEN 0 ELSE 2 END + CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END", f"(CASE WHEN l.initial = '{initial}' THEN l.role ELSE '{role}' END) || ':' || l.text")
    gone = "fault IN ('blank', 'duplicate')"
    lost = {k: add(f"f.{k}", "'D'", 3) for k in STATES}
    never = "{'c': 1000000000000000, 'p': '', 't': CAST([] AS VARCHAR[])}"
    return rf"""
    WITH RECURSIVE {CRC_SQL},
    z AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations, crc),
    w AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM z WHERE kind <> 0),
    n AS (SELECT *, left(role, 1) AS initial, trim(text, {space}) AS bare, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM w),
    m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM n),
    l AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM m),
    f AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'p': '', 't': CAST([] AS VARCHAR[])}} AS o, {never} AS s, {never} AS u, {never} AS a FROM l
          UNION ALL SELECT f.conv_id, f.i + 1, {lost['o']},
            CASE WHEN {gone} OR l.initial <> 's' THEN {lost['s']} ELSE {least(lost['s'], keep('f.o', 's', 'system'))} END,
            CASE WHEN {gone} THEN {lost['u']} ELSE {least(lost['u'], keep('f.o', 'u', 'user'), keep('f.s', 'u', 'user'), keep('f.a', 'u', 'user'), keep(put('f.u', 'assistant'), 'u', 'user'))} END,
            CASE WHEN {gone} THEN {lost['a']} ELSE {least(lost['a'], keep('f.u', 'a', 'assistant'), keep(put('f.o', 'user'), 'a', 'assistant'), keep(put('f.s', 'user'), 'a', 'assistant'), keep(put('f.a', 'user'), 'a', 'assistant'))} END
          FROM f JOIN l ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND l.i = f.i + 1),
    e AS (SELECT conv_id, {least('o', 'a', put('u', 'assistant'), put(put('s', 'user'), 'assistant'))} AS best FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
    c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                 count(*) FILTER (prior || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM l GROUP BY conv_id)
    SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.p, '') AS audit,
           sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) AS v LEFT JOIN c ON v.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON v.conv_id IS NOT DISTINCT FROM e.conv_id
    """
