"""Line dedup by a log-template tree, in Spark SQL functions only.

Lines are parsed to a fixed depth: the token count, then the first ``depth``
tokens, with every token that holds a digit read as the wildcard ``<*>``.
Lines of one leaf are grouped into templates: the most widespread line of the
leaf is the template's pattern, and a line that agrees with it in at least
``similarity`` of its tokens belongs to it (where they differ, the pattern has
a variable field).  Lines left over give the leaf its next template, until no
line is left; a round settles the next ``BATCHES`` lines of every leaf at once.

A template found in ``min_docs`` documents or more recurs: its lines are
dropped from all documents but the first that has it (smallest ``doc_id``),
so no content leaves the corpus altogether.

Texts are read twice.  The first pass finds the leaves that several documents
share and marks them in a bit map of ``2**FILTER_BITS`` bits, which is
broadcast (its size does not depend on the input); the second pass writes the
lines of marked leaves.  A leaf marked by mistake does no harm: its lines are in
one document and recur nowhere.  Counts are pre-aggregated per document and
line, so neither a common line nor a common leaf makes a task large; the documents of
a common template are dealt to ``SALTS`` parts.

Defined results: a null text has no lines and stays null; blank lines and
lines of fewer than ``min_tokens`` tokens are never dropped (the query and the
pipeline set it to 1, so none is left out); a line of up to ``depth`` tokens is
a leaf of its own, and if all of them hold digits it recurs only as it is
written, as nothing else would tell two numbers apart; equal rows (same
id and text) are the same document; documents with equal ids but other texts
are ordered by the hash of the text; a null ``doc_id`` comes last; all columns
of the input are kept, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veracity.session import cut_lineage

# White space besides blank and line end, fields that vary (one
# token; the look-behind keeps long tokens linear), and the wildcard.
WHITE = ("\t", "\x0b", "\x0c", "\r")
VARIABLE = r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+"
WILDCARD = "<*>"
# A line of nothing but one to three fields that vary.
BARE = r"^<\*>(?: <\*>){0,2}$"
# Characters that change in a line, besides blanks at its ends and doubled ones.
CHANGES = "[\t\x0b\x0c\r0-9]"
FILTER_BITS = 26
SALTS = 32  # parts that the documents of one template are dealt to
# Lines of a leaf that the first, second, ... round settles (the last size goes on
# until all are); they bound a row's size, not the number of patterns.
BATCHES = (4, 16, 64, 256)


def masked_lines(text: Column) -> Column:
    """Lines with one blank between tokens, tokens with digits as wildcards, but bare numbers as they are written.

    Most lines have nothing to change and are only looked at; each is masked
    once, inside the array that the lines are exploded from.
    """
    def plain(line):
        for c in WHITE:
            line = F.replace(line, F.lit(c), F.lit(" "))
        return F.trim(F.regexp_replace(line, " {2,}", " "))

    def mask(line):
        return F.transform(F.array(plain(line)), lambda p: F.transform(
            F.array(F.regexp_replace(p, VARIABLE, WILDCARD)), lambda m: F.when(m.rlike(BARE), p).otherwise(m))[0])[0]

    def changes(line):
        return F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" ")) | line.rlike(CHANGES)

    return F.transform(F.split(text, "\n"), lambda line: F.when(changes(line), mask(line)).otherwise(line))


def _key(id_col: str, text_col: str) -> list[Column]:
    return [F.col(id_col).cast("long").alias("k_id"), F.xxhash64(text_col).alias("k_text")]


def _lines(df: DataFrame, id_col: str, text_col: str, depth: int, min_tokens: int) -> DataFrame:
    """``k_id, k_text, pos, masked, leaf``: every line long enough."""
    one = df.where(F.col(text_col).isNotNull()).select(
        *_key(id_col, text_col), F.posexplode(masked_lines(F.col(text_col))).alias("pos", "masked"))
    blanks = F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "), F.lit("")))
    return one.where((F.col("masked") != "") & (blanks + 1 >= min_tokens)).select(
        "k_id", "k_text", "pos", "masked", F.xxhash64(blanks, F.substring_index("masked", " ", depth)).alias("leaf"))


def _place(leaf: str = "leaf") -> tuple[Column, Column]:
    """Word and bit of a leaf in the bit map."""
    return F.shiftrightunsigned(leaf, 70 - FILTER_BITS), F.shiftrightunsigned(leaf, 64 - FILTER_BITS).bitwiseAND(F.lit(63))


def _shared_lines(df: DataFrame, id_col: str, text_col: str, depth: int, min_tokens: int) -> DataFrame:
    """Lines whose leaf is in several documents (and a few of other leaves)."""
    lines = _lines(df, id_col, text_col, depth, min_tokens)
    word, bit = _place()
    shared = lines.select("leaf", F.xxhash64("k_id", "k_text").alias("doc")).groupBy("leaf").agg(
        F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi")
    bits = cut_lineage(shared.groupBy(word.alias("word")).agg(F.bit_or(
        F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))).alias("bits")), "line-filter")
    # 2**(FILTER_BITS - 6) rows of two numbers at most.
    marked = lines.join(F.broadcast(bits), word == F.col("word")).where(F.call_function("getbit", F.col("bits"), bit.cast("int")) == 1)
    return marked.select("k_id", "k_text", "pos", "leaf", F.xxhash64("masked").alias("line"), "masked")


def _agree(a: Column, b: Column) -> Column:
    """Positions at which two token arrays of equal length hold the same token."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))


def _fits(a: Column, b: Column, similarity: float) -> Column:
    return _agree(a, b) >= F.size(a) * similarity


def _patterns(ranked: Column, similarity: float) -> Column:
    """The lines, in their order, that fit no pattern before them."""
    return F.aggregate(ranked, F.slice(ranked, 1, 0), lambda found, x: F.when(
        F.exists(found, lambda p: _fits(x["toks"], p["toks"], similarity)), found).otherwise(F.concat(found, F.array(x))))


def _segments(depth: int, similarity: float) -> Column:
    """Hashes of the segments of ``toks`` after the leaf's tokens, one more than tokens that may differ.

    Two lines of a leaf that fit each other agree in one of them.
    """
    return F.expr(f"""element_at(transform(array(named_struct('n', size(toks), 'm', greatest(size(toks) - {depth}, 0),
        's', cast(floor(size(toks) * {1 - similarity} + 1e-6) as int) + 1)),
        v -> transform(sequence(0, v.s - 1), i -> xxhash64(i, array_join(slice(toks, {depth} + 1 + (i * v.m) div v.s,
             ((i + 1) * v.m) div v.s - (i * v.m) div v.s), ' ')))), 1)""")


def _with_company(lines: DataFrame, depth: int, similarity: float) -> DataFrame:
    """Lines that agree in a segment with another line of their leaf; the others fit no line but themselves."""
    keyed = lines.select("leaf", "line", F.explode(_segments(depth, similarity)).alias("segment"))
    met = keyed.groupBy("leaf", "segment").agg(F.min("line").alias("lo"), F.max("line").alias("hi")).where("lo <> hi")
    company = keyed.join(met.select("leaf", "segment"), ["leaf", "segment"]).select("leaf", "line").distinct()
    return lines.join(company, ["leaf", "line"])


def templates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, min_tokens: int = 4,
              similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Line occurrences by document, and ``leaf, line -> template`` of lines that are not their own."""
    read = cut_lineage(_shared_lines(df, id_col, text_col, depth, min_tokens), "line-hashes")
    found = read.drop("masked")
    in_doc = F.xxhash64("k_id", "k_text")
    per_doc = found.select("leaf", "line", in_doc.alias("doc")).distinct()
    spread = per_doc.groupBy("leaf", "line").agg(F.count("*").alias("docs"), F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    spread = cut_lineage(spread, "line-spread")
    # Leaves with several lines of several documents: only there is anything to generalise.
    open_leaves = spread.groupBy("leaf").agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where(
        "n > 1 and lo <> hi").select("leaf")
    texts = read.groupBy("leaf", "line").agg(F.any_value("masked").alias("masked")).join(open_leaves, "leaf")
    # Only lines of which a token may differ can fit another line.
    texts = texts.select("leaf", "line", F.split("masked", " ").alias("toks")).where(
        F.floor(F.size("toks") * (1 - similarity) + 1e-6) > 0)
    texts = _with_company(cut_lineage(texts, "line-texts"), depth, similarity)
    rest = cut_lineage(texts.join(spread.select("leaf", "line", "docs"), ["leaf", "line"]), "line-leaves")
    assigned, k = None, 0
    # Most widespread first; ties go to the first line in the order of its tokens.
    rank = F.struct((-F.col("docs")).alias("d"), "toks", "line")
    while assigned is None or not rest.isEmpty():
        size = BATCHES[min(k, len(BATCHES) - 1)]
        # The limit is applied before the shuffle, so a large leaf sends few lines to one task.
        heads = rest.withColumn("r", rank).withColumn("at", F.row_number().over(Window.partitionBy("leaf").orderBy("r"))).where(
            F.col("at") <= size).groupBy("leaf").agg(F.array_sort(F.collect_list("r")).alias("heads"))
        heads = heads.select("leaf", F.size("heads").alias("n"), _patterns(F.col("heads"), similarity).alias("patterns"))
        judged = rest.join(heads, "leaf").withColumn("template", F.get(F.filter("patterns", lambda p: _fits(
            F.col("toks"), p["toks"], similarity)), F.lit(0))["line"])
        # A leaf's only line left is its own template.
        judged = cut_lineage(judged.where("n > 1").select("leaf", "line", "toks", "docs", "template"), "line-round")
        own = judged.where("template is not null").select("leaf", "line", "template")
        assigned = own if assigned is None else assigned.unionByName(own)
        rest = judged.where("template is null").select("leaf", "line", "toks", "docs")
        k += 1
    return found, assigned


def dropped_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2,
                  **parse) -> DataFrame:
    """``k_id, k_text, dropped``: positions of the lines to drop, per document that has any."""
    found, assigned = templates(df, id_col, text_col, **parse)
    named = found.join(assigned.where("line <> template"), ["leaf", "line"], "left").select(
        "k_id", "k_text", "pos", "leaf", F.coalesce("template", "line").alias("template"))
    order = F.struct(F.col("k_id").isNull().alias("n"), F.col("k_id").alias("i"), F.col("k_text").alias("t"))
    per_doc = named.groupBy("leaf", "template", "k_id", "k_text").agg(F.collect_set("pos").alias("at"))
    per_doc = cut_lineage(per_doc, "line-templates")
    recurring = per_doc.groupBy("leaf", "template").agg(F.count("*").alias("docs"), F.min(order).alias("first")).where(
        F.col("docs") >= min_docs)
    # One template may be in any number of documents: they are dealt to several tasks.
    dealt = recurring.select("leaf", "template", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = per_doc.withColumn("salt", F.pmod(F.xxhash64("k_id", "k_text"), F.lit(SALTS)).cast("int"))
    later = salted.join(dealt, ["leaf", "template", "salt"]).where(order != F.col("first"))
    return later.groupBy("k_id", "k_text").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("dropped"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "line_dedup",
                **options) -> DataFrame:
    """``df`` with one struct column: ``clean_text``, ``n_lines``, ``n_dropped_lines``, ``dropped``."""
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *_key(id_col, text_col))
    drops = dropped_lines(df.select(F.col(id_col), F.col(text_col)), id_col, text_col, **options).select(
        F.col("k_id").alias("d_id"), F.col("k_text").alias("d_text"), "dropped")
    joined = held.join(drops, F.col("k_id").eqNullSafe(F.col("d_id")) & (F.col("k_text") == F.col("d_text")), "left")
    text = F.col("row").getField(text_col)
    lines = joined.select("row", "dropped", F.split(text, "\n").alias("all_lines"))
    keep = F.array_except(F.sequence(F.lit(0), F.size("all_lines") - 1), F.col("dropped"))
    clean = F.when(F.col("dropped").isNull(), text).otherwise(
        F.array_join(F.transform(keep, lambda i: F.get("all_lines", i)), "\n"))
    return lines.select("row.*", F.struct(
        clean.alias("clean_text"), F.coalesce(F.when(text.isNotNull(), F.size("all_lines")), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).alias("n_dropped_lines"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped")).alias(name))
