"""Fixed-length WordPiece ids and attention mask."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens import session
from reviewlens.functions.tokens import cleaned_words
from reviewlens.operators.rows import ROW, numbered_rows
from reviewlens.operators.sequences import pad_back
from reviewlens.operators.vocabulary import WordIndex
from reviewlens.session import byte_size, join_by_size, materialise, spread

# Special pieces come first, in this order; longer words are unknown.
SPECIAL = ["[PAD]", "[UNK]", "[CLS]", "[SEP]"]
MAX_WORD_CHARS = 100


def piece_vocabulary(index: WordIndex) -> DataFrame:
    """(piece, piece_id): specials, single characters, continuation characters, then frequent words."""
    letters = string.digits + string.ascii_lowercase
    fixed = SPECIAL + list(letters) + [f"##{c}" for c in letters]
    spark = index.table.sparkSession
    head = spark.createDataFrame(list(zip(fixed, range(len(fixed)))), "piece string, piece_id int")
    # Longer words are unknown anyway, so num_words short rows bound the vocabulary.
    words = index.table.filter(F.length("word").between(2, MAX_WORD_CHARS)).select(
        F.col("word").alias("piece"), (F.col("idx") + F.lit(len(fixed) - 1)).alias("piece_id")
    )
    return materialise(head.unionByName(words))


def fitting_pieces(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, steps): all pieces that stand somewhere in a word, by place and, at a place, the longest first.

    All beginnings and inner parts of a word, up to the longest piece there is, meet the vocabulary in one join.
    """
    pieces = vocabulary.filter(~F.col("piece").isin(SPECIAL))
    inner = F.col("piece").startswith("##")
    longest = pieces.agg(
        F.max(F.when(~inner, F.length("piece"))).alias("first"), F.max(F.when(inner, F.length("piece") - 2)).alias("inner")).first()
    size = F.length("word")

    def parts(at: Column, most: Column, mark: str) -> Column:
        return F.transform(F.sequence(F.lit(1), most), lambda n: F.struct(
            at.cast("int").alias("at"), n.cast("int").alias("n"),
            F.concat(F.lit(mark), F.substring(F.col("word"), at + F.lit(1), n)).alias("piece")))

    starts = parts(F.lit(0), F.least(size, F.lit(longest["first"] or 1)), "")
    rest = F.when(size > 1, F.flatten(F.transform(
        F.sequence(F.lit(1), size - 1), lambda at: parts(at, F.least(size - at, F.lit(longest["inner"] or 1)), "##"))))
    tried = words.filter(size <= MAX_WORD_CHARS).select(
        "word", F.explode(F.concat(starts, F.coalesce(rest, F.slice(starts, 1, 0)))).alias("t")).select("word", "t.*")
    found = join_by_size(tried, pieces, ["piece"], "inner", byte_size(pieces), ["word", "at"])
    # The group is the parts of one word of at most MAX_WORD_CHARS characters.
    return found.groupBy("word").agg(
        F.array_sort(F.collect_list(F.struct("at", (-F.col("n")).alias("less"), F.col("piece_id").alias("id")))).alias("steps"))


def word_pieces(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, ids) of distinct words: longest piece first; a word that can't be covered is one unknown piece."""
    unknown = F.array(F.lit(SPECIAL.index("[UNK]")))
    nothing = F.struct(F.lit(0).alias("at"), F.slice(unknown, 1, 0).alias("ids"))

    def step(so_far: Column, piece: Column) -> Column:
        # Of the pieces at a place the longest comes first; it moves the walk on, past the others.
        taken = F.struct((piece["at"] - piece["less"]).alias("at"), F.concat(so_far["ids"], F.array(piece["id"])).alias("ids"))
        return F.when(so_far["at"] == piece["at"], taken).otherwise(so_far)

    known = words.join(fitting_pieces(words, vocabulary), "word", "left").select(
        "word", F.aggregate("steps", nothing, step).alias("walked"))
    whole = F.coalesce(F.col("walked.at") == F.length("word"), F.lit(False))
    return known.select("word", F.when(whole, F.col("walked.ids")).otherwise(unknown).alias("ids"))


def encode(docs: DataFrame, keys: list[str], text: str, vocabulary: DataFrame, max_length: int) -> DataFrame:
    """(keys, empty, input_ids, attention_mask) of exactly ``max_length`` elements, for each row of docs.

    A word that is a piece as a whole needs no cutting; each other distinct word is cut once, by joins, and its
    ids are joined back to where it stands. Every word gives at least one piece, so only the first max_length - 2
    words can show in the result; the others need not be cut. ``vocabulary`` should be a materialised table.
    """
    room = max_length - 2
    # Written, so that texts are cleaned once; what is left of a text is a bounded number of words, and only
    # these are moved.
    texts = materialise(numbered_rows(docs, keys, text).select(
        *keys, *ROW, F.slice(cleaned_words(F.col(text)), 1, room).alias("_words")))
    whole = vocabulary.filter(~F.col("piece").isin(SPECIAL) & (F.length("piece") <= MAX_WORD_CHARS)).select(
        F.col("piece").alias("word"), F.array("piece_id").alias("_whole"))
    whole_bytes = byte_size(whole.select("word"))
    words = texts.select(F.explode("_words").alias("word")).distinct()
    # Words are few bytes but many parts, so they are spread by more than their size; all below stays in place.
    distinct = materialise(join_by_size(words, whole, ["word"], "left_anti", whole_bytes, ["word"]))
    pieces = materialise(word_pieces(spread(distinct, ["word"]), vocabulary))
    size = pieces.agg(F.sum(F.octet_length("word") + 4 * F.size("ids") + 32)).first()[0] or 0
    small = size <= session.BROADCAST_LIMIT_BYTES
    placed = (spread(texts, ["_spot"]) if small else texts).select(
        *keys, *ROW, (F.size("_words") == 0).alias("empty"), F.posexplode_outer("_words").alias("pos", "word"))
    found = join_by_size(placed, whole, ["word"], "left", whole_bytes, [*ROW, "pos"])
    if small:
        known = found.join(F.broadcast(pieces), "word", "left").withColumn("ids", F.coalesce("_whole", "ids"))
    else:
        # Words grow with the texts, but the frequent ones are pieces: only the rest meets the large table, and
        # needs no salt, which would repeat that table.
        cut = F.col("_whole").isNull() & F.col("word").isNotNull()
        rest = found.filter(cut).join(pieces, "word")
        known = found.filter(~cut).withColumn("ids", F.col("_whole")).unionByName(rest)
    # The group is at most max_length - 2 words of one text.
    in_order = F.array_sort(F.collect_list(F.when(F.col("ids").isNotNull(), F.struct("pos", "ids"))))
    grouped = known.groupBy(*keys, *ROW, "empty").agg(F.slice(F.flatten(in_order["ids"]), 1, room).alias("_pieces"))
    ids = F.concat(
        F.array(F.lit(SPECIAL.index("[CLS]"))), F.col("_pieces"), F.array(F.lit(SPECIAL.index("[SEP]")))
    )
    with_ids = grouped.select(*keys, "empty", ids.alias("_ids"))
    return with_ids.select(
        *keys, "empty",
        pad_back(F.col("_ids"), max_length).alias("input_ids"),
        pad_back(F.transform("_ids", lambda _: F.lit(1)), max_length).alias("attention_mask"),
    )
