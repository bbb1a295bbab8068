"""How filters interact: what each removes, repeats or alone finds, in every order in which they can be applied.

Every text is looked at once: which filters it fails is a mask of five bits. Masks are counted by part of the corpus, and so
are the masks of good and of toxic texts, which gives three rows of 32 numbers for each part. Stacked, these rows are
multiplied by integer matrices of 32 by 600 (all masks; 120 orders of five steps) that hold a 1 where a text of this mask is kept,
removed, redundant or alone at this step. So all orders cost one product, whatever the size of the corpus."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import BROADCAST_BYTES, drop_saved, save, small, split_join
from glyphlake.llm.shingles import UPPER

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MASKS, STEPS = 1 << len(FILTERS), len(FILTERS)
MARKS = r"[#$%&*|]"


def failed_by_text(text: Column) -> Column:
    """The bits (A is 1, B 2, C 4, D 8) of the filters that look at one text alone."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    upper = F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))
    fails = [
        F.size(words) < 50,
        F.size(F.array_distinct(words)) * 100 < F.size(words) * 65,
        upper * 100 > F.char_length(text) * 5,
        text.rlike(MARKS),
    ]
    return sum(F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails))


def masked(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """(id, part, mask) of every row, and the saved tables that it reads. A text fails E (16) if an equal one has a smaller id; texts
    are compared by their SHA-256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), failed_by_text(text).alias("own"), F.unhex(F.sha2(text, 256)).alias("digest"))
    marks = save(own, "audit-marks")
    repeated = save(marks.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("rows")).where("rows > 1"), "audit-repeated")
    late = F.when(F.coalesce(F.col("id") > F.col("first"), F.lit(False)), MASKS // 2).otherwise(0)
    return split_join(marks, repeated, "digest", "rows", "left").select("id", "part", (F.col("own") + late).alias("mask")), [marks, repeated]


def histograms(masks: DataFrame, labels: DataFrame, label_id: str, quality_col: str, toxic_col: str, broadcast_bytes: int) -> tuple[DataFrame, list[DataFrame]]:
    """(part, mask, docs, good, toxic) of every mask that a part has, and the saved tables that it reads. Rows of one id are
    counted together before they meet their labels."""
    counts = masks.groupBy("id", "part", "mask").agg(F.count("*").alias("n"))
    yes = lambda c: F.coalesce(F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))), F.lit(0))
    marked = save(labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("id")).agg(yes(quality_col).alias("q"), yes(toxic_col).alias("t")).where("q + t > 0"), "audit-labels")
    known = counts.join(small(marked, broadcast_bytes), "id", "left")
    lost = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0))
    return known.groupBy("part", "mask").agg(F.sum("n").alias("docs"), lost("q").alias("good"), lost("t").alias("toxic")), [marked]


def outcome_matrices() -> dict[str, np.ndarray]:
    """For each outcome the matrix of 32 masks by 600 (order, step) that holds a 1 where a text of the mask has it."""
    mask = np.arange(MASKS)[:, None]
    its = np.array([1 << FILTERS.index(f) for order in ORDERS for f in order])[None, :]
    before = np.array([sum(1 << FILTERS.index(f) for f in order[:k]) for order in ORDERS for k in range(STEPS)])[None, :]
    fails, earlier = mask & its > 0, mask & before > 0
    found = {"kept": ~fails & ~earlier, "removed": fails & ~earlier, "redundant": fails & earlier, "unique_fails": (mask == its) & (before >= 0)}
    return {name: m.astype(np.int64) for name, m in found.items()}


OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def multiplied(histogram: DataFrame) -> DataFrame:
    """The products, as 600 rows for each part."""
    by_part = histogram.groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("cells"))  # 32 at most

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices, columns = outcome_matrices(), len(ORDERS) * STEPS
        its = np.array([FILTERS.index(f) for order in ORDERS for f in order])
        of_filter = (its[:, None] == np.arange(STEPS)[None, :]).astype(np.int64)
        order, step = np.repeat(ORDERS, STEPS), np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS))
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256).to_pylist()
                stacked = np.zeros((3, len(rows), MASKS), np.int64)
                for i, row in enumerate(rows):
                    for cell in row["cells"]:
                        stacked[:, i, cell["mask"]] = cell["docs"], cell["good"], cell["toxic"]
                docs, good, toxic = stacked
                out = {name: docs @ m for name, m in matrices.items()}
                out |= {"good_lost": good @ matrices["removed"], "toxic_lost": toxic @ matrices["removed"], "shapley": (out["removed"] @ of_filter)[:, its]}
                parts = pa.array([row["part"] for row in rows]).take(pa.array(np.repeat(np.arange(len(rows)), columns)))
                yield pa.RecordBatch.from_arrays([parts, pa.array(np.tile(order, len(rows)).tolist()), pa.array(np.tile(step, len(rows))), *[pa.array(m.ravel()) for m in out.values()]], names=["part", "filter_order", "step", *out])

    return by_part.mapInArrow(made, OUT)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", label_id: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows for each part
    that occurs, zeros included.

    Filters, by what fails them: A under 50 words; B 100 * distinct words < 65 * words; C 100 * capitals (A-Z) > 5 * code points;
    D any of #$%&*|; E equal to the text of any smaller id, in any part, removed or not. Words are separated by ASCII white
    space and told apart by case. Null texts count as empty ones, null parts as the empty part; very long texts are taken
    whole. Repeated rows count as often as they occur; rows of one id aren't E to each other; a null id is neither smaller nor
    larger than any, so its row never fails E, nor has it labels. Of several label rows of an id one that is 1 suffices. Empty
    tables give no rows, empty labels zeros. Other columns are ignored."""
    masks, first = masked(docs, id_col, text_col, part_col)
    table, more = histograms(masks, labels.select(label_id, quality_col, toxic_col), label_id, quality_col, toxic_col, broadcast_bytes)
    result = save(multiplied(table), "audit-result")
    drop_saved(*first, *more)
    return result
