"""I-Match fingerprints over randomised lexicon subsets. DataFrame functions only.

Terms are runs of letters and digits in lower case. The lexicon holds the terms whose
document frequency lies in a band (``low`` to ``high`` of all documents). Each of
``SUBSETS`` random subsets of the lexicon keeps a term with chance 1/2, 1/4, … 1/256;
a document's distinct terms in a subset are sorted, joined and hashed. A fingerprint is
the row of these hashes, ``-`` where no term is in the subset. Likeness is the share of
equal hashes among the subsets in which either document has a term. Thin subsets still
agree when much of a text has changed, thick ones only for near copies.

The lexicon's size does not grow with the corpus: a term in ``low`` of all documents
needs that many (document, term) pairs, so there are at most (distinct terms of the
mean document) / low of them. It is counted before it is brought into the plan as one
constant, a table of hash buckets, so that terms are looked up in the row where they stand:
no join, and no row per term.

Nulls: a null text is an empty one; a null doc_id comes after all others in descending
order. A document without a lexicon term gets ``*`` and the hash of all its distinct
terms; two of those are alike (1.0) if these are equal, else 0.0. Documents of the same
id follow in the order of their text; fully equal rows are kept, each with its next.
A single document is next to itself. An empty table gives no rows. Other columns are
ignored; texts are read whole.
"""

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trajlake.llm.common import ids_and_texts, save

LOW, HIGH = 0.005, 0.1
DENSITIES = (1, 2, 3, 4, 5, 6, 7, 8)  # a term is kept with chance 2**-d
REPEATS = 5
SUBSETS = len(DENSITIES) * REPEATS
LEXICON_ROWS = 1_000_000  # more is an error: lower bands must have shorter documents
# Documents are cut into 2**depth ranges of doc_id, of some RANGE_ROWS documents each within these depths.
LEAST_DEPTH, MOST_DEPTH = 9, 14
RANGE_ROWS = 1000


def terms(text: Column) -> Column:
    """Distinct terms, in any order."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), "[^\\p{L}\\p{N}]+")), "")


def lexicon(texts: DataFrame, low: float = LOW, high: float = HIGH, seed: int = 0) -> DataFrame:
    """``term`` and ``mask``: bit s tells that the term is in subset s."""
    found = texts.select(F.explode(terms(F.col("text"))).alias("term"))
    total = texts.count()
    counted = found.groupBy("term").agg(F.count("*").alias("df"))
    band = counted.where((F.col("df") >= max(2, low * total)) & (F.col("df") <= max(2, high * total)))
    mask = F.lit(0).cast("long")
    for s in range(SUBSETS):
        d = DENSITIES[s % len(DENSITIES)]
        kept = F.pmod(F.xxhash64("term", F.lit(s), F.lit(seed)), F.lit(1 << d)) == 0
        mask = mask.bitwiseOR(F.when(kept, F.lit(1 << s).cast("long")).otherwise(F.lit(0).cast("long")))
    return save(band.select("term", mask.alias("mask")), "lexicon")


def lookup(known: DataFrame) -> Column:
    """The lexicon as one constant array of buckets, each a string `` term=mask term=mask `` (mask in 16 hex digits)."""
    n = known.count()
    if n > LEXICON_ROWS:
        raise ValueError(f"a lexicon of {n} terms is beyond {LEXICON_ROWS}; raise the lower bound of the band")
    size = 1 << max(1, n).bit_length()
    entry = F.concat("term", F.lit("="), F.lpad(F.hex("mask"), 16, "0"))
    buckets = [" "] * size
    for row in known.select(F.pmod(F.xxhash64("term"), F.lit(size)).alias("b"), entry.alias("e")).collect():
        buckets[row.b] += row.e + " "
    return F.split(F.lit("\n".join(buckets)), "\n")


def in_lexicon(found: Column, table: Column) -> Column:
    """The terms that the lexicon holds, sorted, as array of struct(term, mask in hex)."""

    def entry(term: Column) -> Column:
        bucket = F.element_at(table, (F.pmod(F.xxhash64(term), F.size(table).cast("long")) + 1).cast("int"))
        start = F.instr(bucket, F.concat(F.lit(" "), term, F.lit("=")))
        return F.struct(term.alias("term"), F.when(start > 0, F.substring(bucket, start + F.char_length(term) + 2, F.lit(16))).alias("mask"))

    kept = F.filter(F.transform(found, entry), lambda x: x["mask"].isNotNull())
    return F.transform(F.array_sort(kept), lambda x: F.struct(x["term"].alias("term"), F.conv(x["mask"], 16, -10).cast("long").alias("mask")))


def subset_hashes(kept: str) -> Column:
    """Hashes by subset of a column of lexicon terms, an array of struct(term, mask) sorted by term."""
    joined = (
        f"transform(sequence(0, {SUBSETS - 1}), s -> "
        f"array_join(transform(filter({kept}, x -> getbit(x.mask, s) = 1), x -> x.term), ' '))"
    )
    return F.expr(f"transform({joined}, j -> if(j = '', '-', lower(hex(xxhash64(j)))))")


def likeness(a: str, b: str) -> Column:
    """Share of equal hashes of two arrays among those where either is not ``-``; 1.0 for equal arrays.

    An array of one stands for a document without lexicon terms.
    """
    pairs = f"arrays_zip({a}, {b})"
    full = F.expr(f"size(filter({pairs}, p -> p.{a} != '-' or p.{b} != '-'))")
    same = F.expr(f"size(filter({pairs}, p -> p.{a} = p.{b} and p.{a} != '-'))")
    plain = (F.size(a) == 1) | (F.size(b) == 1)
    return F.when(F.col(a) == F.col(b), 1.0).when(plain, 0.0).otherwise(F.coalesce(F.try_divide(same, full), F.lit(0.0)))


def range_of(doc_id: Column, bounds: list[int], depth: int) -> Column:
    """How many of the 2**depth - 1 sorted bounds are at most ``doc_id``, by binary search; 0 for null."""
    # One string, as a list would be a node of the plan for each bound.
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>")
    steps = F.array(*[F.lit(1 << k) for k in range(depth - 1, -1, -1)])
    return F.aggregate(
        steps, F.lit(0), lambda place, step: F.when(F.element_at(table, place + step) <= doc_id, place + step).otherwise(place)
    )


def spread_ranges(texts: DataFrame) -> tuple[DataFrame, WindowSpec]:
    """The rows by ``block``, and the window along a block by descending doc_id; rows with ``guest`` 1 are copies.

    Rows are cut into ranges of doc_id at sampled quantiles; the first row of each range
    is copied to the range before it in that order. So each text moves once and no task
    sees more than a range.
    """
    depth = min(MOST_DEPTH, max(LEAST_DEPTH, (texts.count() // RANGE_ROWS).bit_length()))
    size = (1 << depth) - 1
    bounds = texts.select("doc_id").approxQuantile("doc_id", [(i + 1) / (size + 1) for i in range(size)], 1 / (4 * size))
    bounds = [int(x) for x in bounds] or [0] * size
    blocked = texts.withColumn("block", range_of(F.col("doc_id"), bounds, depth))
    # One row per range: the highest id in it, and the range that precedes it in the order (around the end).
    heads = save(blocked.groupBy("block").agg(F.max("doc_id").alias("_top")), "heads")
    order = Window.orderBy(F.col("block").asc())
    heads = heads.select(
        F.col("block").alias("_b"), "_top", F.lead("block").over(order).alias("_to"), F.min("block").over(Window.partitionBy()).alias("_low")
    )
    heads = heads.select("_b", "_top", F.coalesce("_to", "_low").alias("_to"))
    marked = blocked.join(
        F.broadcast(heads), (F.col("block") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("_top")), "left"
    )
    copies = F.when(F.col("_b").isNull(), F.array(F.struct(F.col("block").alias("block"), F.lit(0).alias("guest")))).otherwise(
        F.array(
            F.struct(F.col("block").alias("block"), F.lit(0).alias("guest")),
            F.struct(F.col("_to").alias("block"), F.lit(1).alias("guest")),
        )
    )
    spread = marked.select("doc_id", "text", F.explode(copies).alias("_c")).select("doc_id", "text", "_c.block", "_c.guest")
    return spread, Window.partitionBy("block").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")


def with_next(texts: DataFrame) -> DataFrame:
    """Add ``row`` and ``block`` (a key of the row) and ``next``, the text of the next row by descending doc_id."""
    spread, along = spread_ranges(texts)
    rows = spread.withColumn("next", F.lead("text").over(along)).withColumn("row", F.row_number().over(along))
    return rows.where("guest = 0").drop("guest")


def edited_text(text: Column, following: Column) -> Column:
    """The last floor(n/2) code points replaced by the first as many of the following text."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH, seed: int = 0) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``."""
    texts = ids_and_texts(docs)
    table = lookup(lexicon(texts, low, high, seed))

    def printed(rows: DataFrame, column: str, name: str) -> DataFrame:
        """Add the fingerprint of a text column, an array of hashes; without lexicon terms one hash, that of all terms."""
        rows = rows.withColumn("_terms", terms(F.col(column)))
        whole = F.hex(F.xxhash64(F.array_join(F.array_sort("_terms"), " "))).alias("_whole")
        rows = rows.select(*[c for c in rows.columns if c != "_terms"], whole, in_lexicon(F.col("_terms"), table).alias("_known"))
        return rows.withColumn(
            name, F.when(F.size("_known") == 0, F.array(F.concat(F.lit("*"), F.col("_whole")))).otherwise(subset_hashes("_known"))
        ).drop("_whole", "_known")

    # Each text's fingerprint is made once and then handed to the row before it, as its next.
    spread, along = spread_ranges(texts)
    rows = printed(spread, "text", "_ft").withColumns({"next": F.lead("text").over(along), "_fn": F.lead("_ft").over(along)})
    rows = rows.where("guest = 0").select("doc_id", "text", "_ft", "_fn", edited_text(F.col("text"), F.col("next")).alias("edited"))
    prints = printed(rows, "edited", "_fe")
    return prints.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.array_join("_ft", ".").alias("fingerprint"),
        F.array_join("_fe", ".").alias("edited_fingerprint"),
        likeness("_ft", "_fe").alias("near_edited"),
        likeness("_ft", "_fn").alias("near_next"),
    )
