r"""Chat formatting with a grammar round trip, on built-in functions.

A turn is an opening mark, a space, the text, a space and a closing mark; each of the common
roles has marks of its own, any other role is a marked name before a marked text.  A
conversation is its turns in order, a line break after each.

Reading is deterministic.  Marks cut the text: between an opening mark and its closing mark
is a body, and between turns nothing but a line break.  Anything else is no conversation.

A mark inside a text would be read as one.  So each turn is rendered, read back and compared
with its source; where it differs, every string like a mark gets one backslash more after its
first character (``[INST]`` becomes ``[\INST]``, and ``[\INST]`` ``[\\INST]``), and it is
rendered, read and compared again.  Reading takes one backslash off each such string.  No mark
is left after one escape, so the second reading is the source; if it were not, the query would
fail and not write a wrong text.  Texts without such strings stay as they are.  Whole
conversations are read and compared once more.

Places are running sums over the turns of a conversation, in UTF-8 bytes, so a body is cut
out without scanning what is before it.

Defined results
    * null texts and null roles are empty; a null conv_id is one conversation;
    * turns go by turn (null first), then role, then text; repeated rows are turns;
    * extra columns are ignored; an empty table gives an empty result;
    * a conversation is one string, so it holds 2 GB at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Role -> opening and closing mark.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYSTEM]", "[/SYSTEM]")}
#: Marks of the name of any other role and of its text.
NAME, TURN = ("[ROLE]", "[/ROLE]"), ("[TURN]", "[/TURN]")
PAIRS = (*MARKS.values(), NAME, TURN)

#: Marks as they are, and strings like them: any number of backslashes after the first character.
MARK = r"\[/?(?:INST|SYSTEM|ROLE|TURN)\]|</?s>"
LIKE = r"(\[)(\\*/?(?:INST|SYSTEM|ROLE|TURN)\])|(<)(\\*/?s>)"
ESCAPED = r"(\[)\\(\\*/?(?:INST|SYSTEM|ROLE|TURN)\])|(<)\\(\\*/?s>)"

LOSS_ROLE = "assistant"
TURNS = "array<struct<role string, text string>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, LIKE, r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$3$2$4")


def _lead(role: Column, name: Column) -> Column:
    """What comes before the body of a turn."""
    other = F.concat(F.lit(f"{NAME[0]} "), name, F.lit(f" {NAME[1]}{TURN[0]} "))
    out = other
    for known, (opening, _) in MARKS.items():
        out = F.when(role == known, f"{opening} ").otherwise(out)
    return out


def _tail(role: Column) -> Column:
    out = F.lit(f" {TURN[1]}\n")
    for known, (_, closing) in MARKS.items():
        out = F.when(role == known, f" {closing}\n").otherwise(out)
    return out


def render(role: Column, name: Column, body: Column) -> Column:
    """One turn; ``name`` and ``body`` are the role and the text as they shall stand there."""
    return F.concat(_lead(role, name), body, _tail(role))


def read(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text, unescaped; null where it is none."""
    marks, between = F.regexp_extract_all(formatted, F.lit(MARK), F.lit(0)), F.split(formatted, MARK)

    def parsed(marks: Column, between: Column) -> Column:
        n = F.size(marks)
        pair = F.transform(
            F.filter(F.sequence(F.lit(0), n), lambda k: (k % 2 == 0) & (k < n)),
            lambda k: F.struct(F.get(between, k).alias("before"), F.get(marks, k).alias("opening"), F.get(between, k + 1).alias("body"), F.get(marks, k + 1).alias("closing")),
        )
        return F.when((n % 2 == 0) & (F.get(between, n) == F.when(n == 0, "").otherwise("\n")), _with(pair, judged))

    def judged(pairs: Column) -> Column:
        def sound(p: Column, k: Column) -> Column:
            fits = F.lit(False)
            for opening, closing in PAIRS:
                fits = fits | ((p["opening"] == opening) & (p["closing"] == closing))
            before = F.get(pairs, k - 1)["opening"]
            named = F.when(k > 0, before == NAME[0]).otherwise(False)
            # A name is followed by its text at once; every other turn begins the text or a line.
            joined = F.when(p["opening"] == TURN[0], named & (p["before"] == "")).otherwise(~named & (p["before"] == F.when(k == 0, "").otherwise("\n")))
            padded = (F.length(p["body"]) >= 2) & p["body"].startswith(" ") & p["body"].endswith(" ")
            return F.struct(F.coalesce(fits & joined & padded, F.lit(False)).alias("sound"), turn(p, k).alias("turn"), (p["opening"] == NAME[0]).alias("name"))

        def turn(p: Column, k: Column) -> Column:
            text = lambda body: unescape(F.substring(body, F.lit(2), F.length(body) - 2))
            role = text(F.get(pairs, k - 1)["body"])
            for known, (opening, _) in MARKS.items():
                role = F.when(p["opening"] == opening, known).otherwise(role)
            return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text(p["body"]), F.lit("")).alias("text"))

        def turns(found: Column) -> Column:
            ends = ~F.coalesce(F.get(found, F.size(found) - 1)["name"], F.lit(False))
            return F.when(F.forall(found, lambda t: t["sound"]) & ends, F.transform(F.filter(found, lambda t: ~t["name"]), lambda t: t["turn"]))

        return _with(F.transform(pairs, sound), turns)

    return _with(marks, lambda m: _with(between, lambda b: parsed(m, b)))


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _round_trip(rows: DataFrame) -> DataFrame:
    """Rows with ``name`` and ``body``: role and text, escaped where a turn would not be read back as it is."""
    source = F.array(F.struct("role", "text")).cast(TURNS)
    same = lambda name, body: F.coalesce(read(render(F.col("role"), name, body)) == source, F.lit(False))
    plain = rows.withColumn("plain", same(F.col("role"), F.col("text")))
    name, body = (F.when(F.col("plain"), F.col(c)).otherwise(escape(F.col(c))) for c in ("role", "text"))
    out = plain.withColumns({"name": name, "body": body})
    held = F.when(F.col("plain"), F.col("body")).when(same(F.col("name"), F.col("body")), F.col("body")).otherwise(F.raise_error(F.lit("a turn does not come back as it was")))
    return out.withColumn("body", held).withColumn("escaped", ~F.col("plain")).drop("plain")


def format_conversations(conversations: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """Per conversation: conv_id, formatted, loss_mask (start and size in UTF-8 bytes, in order) and n_escaped (turns)."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text"))
    turns = _round_trip(rows).withColumn("line", render(F.col("role"), F.col("name"), F.col("body")))
    own = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    before = F.coalesce(F.sum(F.octet_length("line").cast("long")).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = before + F.octet_length(_lead(F.col("role"), F.col("name")))
    placed = turns.withColumn("k", F.row_number().over(own)).withColumn("start", start)
    whole = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("k", "line", "start", F.octet_length("body").cast("long").alias("size"), "role", "text"))).alias("turns"),
        F.count_if("escaped").alias("n_escaped"),
    )
    whole = whole.withColumn("formatted", F.array_join(F.transform("turns", lambda t: t["line"]), ""))
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).cast(TURNS)
    checked = F.when(read(F.col("formatted")) == source, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not come back as it was")))
    mask = F.transform(F.filter("turns", lambda t: t["role"] == loss_role), lambda t: F.struct(t["start"].alias("start"), t["size"].alias("size")))
    return whole.select("conv_id", checked.alias("formatted"), mask.alias("loss_mask"), "n_escaped")


def masked(formatted: Column, mask: Column) -> Column:
    """The texts under a mask, unescaped."""
    raw = formatted.cast("binary")
    return _with(raw, lambda b: F.transform(mask, lambda m: unescape(F.substring(b, (m["start"] + 1).cast("int"), m["size"].cast("int")).cast("string"))))


def op12_chat_format(spark, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    awkward = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", awkward), (-7, 1, "assistant", awkward)], "conv_id long, turn long, role string, text string")
    out = format_conversations(given.unionByName(more))
    back = out.select("conv_id", "formatted", read(F.col("formatted")).alias("turns"), F.array_join(masked(F.col("formatted"), F.col("loss_mask")), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


_LENGTHS = "CASE role " + " ".join(f"WHEN '{role}' THEN {len(a) + len(b) + 3}" for role, (a, b) in MARKS.items()) + f" ELSE {sum(map(len, (*NAME, *TURN))) + 5} + length(regexp_replace(role, '{LIKE}', '\\1\\3\\\\\\2\\4', 'g')) END"

ORACLE_SQL = {
    "op12_chat_format": f"""
WITH c AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = '{LOSS_ROLE}'), '') AS loss,
  CAST(sum({_LENGTHS} + length(regexp_replace(text, '{LIKE}', '\\1\\3\\\\\\2\\4', 'g'))) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g""",
}
