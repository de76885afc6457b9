"""Chat formatting by quotation linking: replies find the messages that they quote, and the quotes go.

A line's quote level is the number of '>' before its text. A message's own text is its lines of level 0, without the line that
announces a quote ("... wrote:"). Neighbouring lines of one level are a passage. Passages and own texts are normalised
(small letters, runs of white space as one space) and hashed: an own text as a whole, by paragraph, and by line. A passage of
level 1 is what the parent said itself, so it is joined with own texts: whole or by paragraph, and, for excerpts, by its lines.
First the earlier messages of the same conversation are asked, then the earliest message of another one. The parent is the message that
most quoted characters come from (then the later one of the same conversation, then the first anywhere). Deeper levels are what the parent
quotes; they are joined in the same way and reported, but they don't decide. A message that quotes nothing known
replies to the one before it in its conversation. Pieces below LEAST characters are known inside a conversation only, and only as a whole
text or paragraph.

Each hash has one source for each conversation, and two anywhere, of two conversations, so a passage that many repeat is joined with one row
only, and one of the two is always another conversation's. A passage that many quote is a hot key: `join_counted` broadcasts those.
Threads are followed to their root by pointer doubling; a link never leads to a message at the same or a later
(conversation, turn) unless it is another conversation's, and links that would close a circle are cut at their smallest message.

Null texts are empty. Messages without text stay, as do repeated rows; of rows with the same (conversation, turn) each gets the
same parent. Very long messages are parsed line by line. Null conversations are one conversation, null turns come first. An empty
table gives an empty table. Columns whose names begin with q_ are replaced; all others pass through.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_counted, ranked, sliced

_LEVEL = re.compile(r"[ \t]?(?:>[ \t]?)+")
_ANNOUNCED = re.compile(r"(?:on|am|le|el)\b.{0,200}\b(?:wrote|schrieb|écrit|escribió)\b.{0,40}:$|.{0,80}\b(?:wrote|schrieb|a écrit|escribió):$", re.I)
#: Shorter pieces say too little to link by.
LEAST = 12


def _plain(text: str) -> str:
    return " ".join(text.lower().split())


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The own text, and the (level, passage) of the quotes in order; passages keep their lines."""
    own, quotes = [], []
    lines = (text or "").replace("\r\n", "\n").split("\n")
    for i, line in enumerate(lines):
        m = _LEVEL.match(line)
        level = m[0].count(">") if m else 0
        if level:
            rest = line[m.end() :]
            if quotes and quotes[-1][0] == level and quotes[-1][2] == i - 1:
                quotes[-1][1].append(rest)
                quotes[-1][2] = i
            else:
                quotes.append([level, [rest], i])
        elif not (i + 1 < len(lines) and _LEVEL.match(lines[i + 1]) and ">" in lines[i + 1][:4] and _ANNOUNCED.match(line.strip())):
            own.append(line)
    clean = re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n")
    return clean, [(level, "\n".join(part)) for level, part, _ in quotes]


def pieces(text: str) -> list[str]:
    """What a text can be known by: the whole, its paragraphs and, if long enough, its lines, normalised, each once."""
    found = dict.fromkeys(_plain(x) for x in [text, *re.split(r"\n[ \t]*\n", text)])
    found |= dict.fromkeys(x for x in map(_plain, text.split("\n")) if len(x) >= LEAST)
    return [x for x in found if x]


def _hashed(text: str) -> list[dict]:
    """The size and 128 bits of the SHA-256 of each piece."""
    return [{"size": len(x), "hash": hashlib.sha256(x.encode("utf-8", "surrogatepass")).digest()[:16]} for x in pieces(text)]


_PIECES = "array<struct<size:int,hash:binary>>"


def _parsed(messages: DataFrame, text: str, whole: bool) -> DataFrame:
    """With `whole`, all columns, q_text (own text) and q_quotes (number of passages); else q_at, q_own (hashed pieces) and q_quoted: for each passage its level and pieces."""
    names = messages.columns
    left = names if whole else ["q_at"]
    made = ["'' AS q_text", "0 AS q_quotes"] if whole else [f"cast(array() AS {_PIECES}) AS q_own", f"cast(array() AS array<struct<level:int,pieces:{_PIECES}>>) AS q_quoted"]
    out = messages.selectExpr(*[f"`{c}`" for c in left], *made)
    titles = out.columns
    piece = pa.list_(pa.struct([("size", pa.int32()), ("hash", pa.binary())]))
    kind = pa.list_(pa.struct([("level", pa.int32()), ("pieces", piece)]))

    def run(batches):
        for batch in sliced(batches):
            found = [parse(t) for t in batch.column(names.index(text)).to_pylist()]
            if whole:
                own = pa.array([t for t, _ in found], pa.string()), pa.array([len(q) for _, q in found], pa.int32())
            else:
                own = pa.array([_hashed(t) for t, _ in found], piece), pa.array([[{"level": level, "pieces": _hashed(p)} for level, p in q] for _, q in found], kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in left), *own], names=titles)

    return messages.mapInArrow(run, out.schema)


def _counted(asked: DataFrame, keyed: DataFrame, keys: list[str]) -> DataFrame:
    """asked joined with keyed, which has each key once; keys that many ask for are no single task's."""
    counts = asked.groupBy(*keys).agg(F.count("*").alias("q_n"))
    keyed = cut(keyed.join(counts, keys))
    return join_counted(asked, keyed, keys, "q_n", keyed.agg(F.sum("q_n")).first()[0] or 0)


def link(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """All columns of messages, and q_text, q_quotes, q_linked (quoted passages, and those with a source), q_parent (conv, turn; null for a root)."""
    messages = messages.drop(*[c for c in messages.columns if c.lower().startswith("q_")])
    base = messages.withColumn("q_at", F.struct(F.col(conv).alias("conv"), F.col(turn).alias("turn")))
    told = cut(_parsed(base.select("q_at", F.col(text).alias("q_said")), "q_said", False))
    # A conversation without an id is one, so its key is text that no id casts to.
    named = F.coalesce(F.col("q_at.conv").cast("string"), F.lit("\0")).alias("conv")
    own = told.select("q_at", named, F.explode("q_own").alias("p")).select("q_at", "conv", "p.*")
    within = cut(own.groupBy("hash", "conv").agg(F.min("q_at").alias("first"), F.max("size").alias("size")))
    early = F.row_number().over(Window.partitionBy("hash").orderBy("first"))
    anywhere = within.filter(F.col("size") >= LEAST).withColumn("place", early).filter("place <= 2").groupBy("hash").agg(F.min("first").alias("far"), F.max("first").alias("next"))
    quotes = told.filter(F.size("q_quoted") > 0).select("q_at", named, F.posexplode("q_quoted").alias("place", "quote"))
    asked = cut(quotes.select("q_at", "conv", "place", F.col("quote.level").alias("level"), F.explode("quote.pieces").alias("p")).select("q_at", "conv", "place", "level", "p.*"))
    near = _counted(asked, within.drop("size"), ["hash", "conv"]).filter(F.col("first") < F.col("q_at"))
    far = _counted(asked.filter(F.col("size") >= LEAST), anywhere, ["hash"])
    far = far.withColumn("first", F.when(F.col("far.conv").eqNullSafe(F.col("q_at.conv")), F.when(F.col("next") != F.col("far"), F.col("next"))).otherwise(F.col("far")))
    both = near.select("q_at", "place", "level", "hash", "size", F.struct(F.lit(0).alias("tier"), "first").alias("source"))
    both = both.unionByName(far.filter("first IS NOT NULL").select("q_at", "place", "level", "hash", "size", F.struct(F.lit(1).alias("tier"), "first").alias("source")))
    found = cut(both.groupBy("q_at", "place", "level", "hash").agg(F.max("size").alias("size"), F.min("source").alias("source")).withColumn("source", F.col("source.first")))
    linked = found.groupBy("q_at").agg(F.countDistinct("place").alias("q_linked"))
    votes = found.filter("level = 1").groupBy("q_at", "source").agg(F.sum("size").alias("size"))
    same = F.col("source.conv").eqNullSafe(F.col("q_at.conv"))
    # Larger is better: most characters, the same conversation, there the later turn, elsewhere the earlier message.
    best = votes.withColumn("vote", F.struct("size", same.alias("same"), F.when(same, F.col("source.turn")).alias("turn"))).withColumn("top", F.max("vote").over(Window.partitionBy("q_at")))
    best = best.filter(F.col("vote").eqNullSafe(F.col("top"))).groupBy("q_at").agg(F.min("source").alias("q_quoted_at"))
    places = _placed(told.select("q_at").distinct())
    parents = places.join(linked, "q_at", "left").join(best, "q_at", "left").withColumn("q_parent", F.coalesce("q_quoted_at", "q_before"))
    parents = _segments(parents.select("q_at", F.coalesce("q_linked", F.lit(0)).alias("q_linked"), "q_parent", "q_before", *CONV, "q_pos"))
    on = F.col("b.q_at").eqNullSafe(F.col("p.q_at"))
    return _parsed(base, text, True).alias("b").join(parents.alias("p"), on, "left").select("b.*", "p.q_linked", "p.q_parent", "p.q_head", "p.q_off")


#: A conversation as two columns without nulls; its messages are numbered and scanned so many at a time, so that a long one is no single task's.
CONV, STRETCH = ("q_c0", "q_c1"), 4096


def _placed(places: DataFrame) -> DataFrame:
    """Adds the conversation's columns, q_pos (place in the conversation), and q_before (the message before)."""
    named = places.withColumns({CONV[0]: F.col("q_at.conv").isNull(), CONV[1]: F.coalesce(F.col("q_at.conv").cast("string"), F.lit(""))})
    at = cut(ranked(named, CONV, F.coalesce(F.floor(F.col("q_at.turn") / 1024), F.lit(-1)), [F.col("q_at.turn").asc_nulls_first()], "q_pos"))
    return at.join(at.select(*CONV, (F.col("q_pos") + 1).alias("q_pos"), F.col("q_at").alias("q_before")), [*CONV, "q_pos"], "left")


def _segments(parents: DataFrame) -> DataFrame:
    """Adds q_head and q_off: a message that doesn't reply to the one before it heads a segment, the others follow their head so many steps behind."""
    heads = F.when(F.col("q_before").isNull() | ~F.col("q_parent").eqNullSafe(F.col("q_before")), F.struct(F.col("q_pos").alias("pos"), F.col("q_at").alias("at")))
    marked = cut(parents.withColumn("q_h", heads).withColumn("q_stretch", F.floor(F.col("q_pos") / STRETCH)))
    so_far = Window.partitionBy(*CONV, "q_stretch").orderBy("q_pos")
    before = Window.partitionBy(*CONV).orderBy("q_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.groupBy(*CONV, "q_stretch").agg(F.max("q_h").alias("q_last")).withColumn("q_carry", F.max("q_last").over(before)).drop("q_last")
    found = marked.withColumn("q_h", F.max("q_h").over(so_far)).join(carried, [*CONV, "q_stretch"]).withColumn("q_h", F.coalesce("q_h", "q_carry"))
    return found.select("q_at", "q_linked", "q_parent", F.col("q_h.at").alias("q_head"), (F.col("q_pos") - F.col("q_h.pos")).alias("q_off"))


def threads(linked: DataFrame) -> DataFrame:
    """(q_at, root, depth) of each message: the pointers of segments' heads, doubled until all reach a root."""
    every = cut(linked.groupBy("q_at").agg(F.min("q_parent").alias("parent"), F.min("q_head").alias("head"), F.min("q_off").alias("off")))
    at = every.filter("off = 0").join(every.select(F.col("q_at").alias("parent"), F.col("head").alias("up"), (F.col("off") + 1).alias("steps")), "parent", "left")
    at = cut(at.select("q_at", F.coalesce("up", "q_at").alias("up"), F.coalesce("steps", F.lit(0)).alias("steps"), F.least("q_at", F.coalesce("up", "q_at")).alias("least")))
    most = 2 * every.count()
    while True:
        moving = at.filter("steps > 0")
        far = at.filter("steps > 0").select(F.col("q_at").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("least").alias("least2"))
        if not moving.join(far.select("up"), "up", "left_semi").limit(1).count():
            roots = at.select(F.col("q_at").alias("head"), F.col("up").alias("root"), "steps")
            return every.join(roots, "head").select("q_at", "root", (F.col("off") + F.col("steps")).alias("depth"))
        after = moving.join(far, "up", "left").select("q_at", F.coalesce("up2", "up").alias("up"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), F.least("least", F.coalesce("least2", "least")).alias("least"))
        at = cut(after.unionByName(at.filter("steps = 0")))
        if at.agg(F.max("steps")).first()[0] > most:  # only a circle takes more steps than there are messages
            inside = at.filter("steps > 0").join(at.select(F.col("up").alias("q_at")).distinct(), "q_at", "left_semi")
            ring = inside.select(F.col("least").alias("q_at")).distinct().withColumn("cut", F.lit(True))
            open_ = linked.join(ring, "q_at", "left")
            return threads(open_.select("q_at", F.when(F.col("cut").isNull(), F.col("q_parent")).alias("q_parent"), "q_head", "q_off"))


def conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """`link` with q_root, q_depth and q_position: a parent comes before its replies, each thread is numbered from 0."""
    linked = cut(link(messages, conv, turn, text))
    ends = threads(linked).select("q_at", F.col("root").alias("q_root"), F.col("depth").alias("q_depth"))
    found = linked.join(ends, "q_at")
    found = found.withColumns({"q_r1": F.coalesce(F.col("q_root.conv").cast("string"), F.lit("")), "q_r2": F.coalesce(F.col("q_root.turn").cast("string"), F.lit(""))})
    order = [F.col("q_at.conv").asc_nulls_first(), F.col("q_at.turn").asc_nulls_first(), F.xxhash64("q_text")]
    found = found.withColumn("q_parent", F.when(F.col("q_root") != F.col("q_at"), F.col("q_parent")))
    out = ranked(found, ["q_r1", "q_r2"], F.col("q_depth"), order, "q_position")
    return out.drop("q_r1", "q_r2", "q_at", "q_head", "q_off")
