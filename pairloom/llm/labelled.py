"""The bounded sample of labelled documents that the classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import held_out, materialize, text_or_empty

#: Bytes of whole texts that a sample has of each label.
BYTES = 32 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int, most_bytes: int = BYTES) -> list[tuple[str, int, float]]:
    """(text, label, weight) of at most `per_class` documents of each label that may be learned from, by the hash of their ids.

    Texts are whole; one that would bring a label's texts over `most_bytes` is passed over, so the driver holds a bounded
    sample however long texts are. A weight is how many labelled documents one of the sample stands for. The ids are
    chosen from the labels alone; the join then has a side of at most two times `per_class` ids, which is broadcast.
    Several labels of one id count by their mean; null labels and ids are left out; of rows that repeat an id and a text
    one counts.
    """
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id")
    one = known.agg((F.avg(column) >= 0.5).cast("int").alias("_label"))
    totals = {r[0]: r[1] for r in one.groupBy("_label").count().collect()}
    first = [one.where(F.col("_label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    ids = F.broadcast(first[0].union(first[1]).select(F.col("doc_id").alias("_id"), "_label"))
    text = text_or_empty()
    own = docs.select("doc_id", text.alias("text")).join(ids, F.col("doc_id") == F.col("_id")).drop("_id")
    found = materialize(own.withColumns({"_text": F.xxhash64("text"), "_bytes": F.octet_length("text")}), "labelled")
    out: list[tuple[str, str, int]] = []
    for k in (0, 1):
        rows = found.where(F.col("_label") == k).groupBy("doc_id", "_text").agg(F.max("_bytes").alias("n"))
        left, chosen = most_bytes, []
        for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id", "n", "_text").limit(per_class).collect():
            if r["n"] <= left:
                left -= r["n"]
                chosen.append((r["doc_id"], r["_text"]))
        if not chosen:
            continue
        kind = dict(docs.dtypes)["doc_id"]
        wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, f"doc_id {kind}, _text long"))
        texts = found.join(wanted, ["doc_id", "_text"], "left_semi").groupBy("doc_id", "_text").agg(F.min("text").alias("text"))
        out += [(str(r["doc_id"]), r["text"], k) for r in texts.collect()]
    have = {k: sum(r[2] == k for r in out) for k in (0, 1)}
    return [(text, label, totals[label] / have[label]) for _, text, label in sorted(out)]
