"""Token counts of flat, unindexed token files by a separator scan.

A token file is nothing but little-endian 16-bit ids, each document ended by a separator id. Blocks of a file are read by
range and searched for separators in one vector operation each; a block reports the gaps between its separators, what
precedes the first and what follows the last. A prefix scan over the blocks of a file then numbers the documents and
stitches those that cross block boundaries.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import filesystem, new_dir, written

#: Bytes of a block of a token file.
BLOCK = 4 << 20


def write_token_files(docs: DataFrame, tokenizer: Callable[[], Callable[[list[str]], list[bytes]]], separator: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """file, n (position in the file), doc_id of every row; one file a task. Null texts are empty; ids must be below 65536 and not the separator."""
    store, path = filesystem(f"{folder}/tokens")
    store.create_dir(path, recursive=True)
    end = np.array([separator], "<u2").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, uri, n, file = tokenizer(), f"{folder}/tokens/{uuid.uuid4().hex}.bin", 0, None
        for batch in batches:
            if file is None:
                s, p = filesystem(uri)
                file = s.open_output_stream(p)
            for raw in encode([t if isinstance(t, str) else "" for t in batch["t"]]):
                ids = np.frombuffer(raw, "<u4")
                if len(ids) and (ids.max() > 0xFFFF or (ids == separator).any()):
                    raise ValueError("an id is the separator or needs more than 16 bits")
                file.write(ids.astype("<u2").tobytes() + end)
            yield pd.DataFrame({"file": uri, "n": np.arange(n, n + len(batch)), "doc_id": batch["i"]})
            n += len(batch)
        if file is not None:
            file.close()

    schema = "file string, n long, doc_id long"
    docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInPandas(run, schema).write.parquet(f"{folder}/names")
    return docs.sparkSession.read.schema(schema).parquet(f"{folder}/names")


def count_tokens(files: DataFrame, separator: int, block: int = BLOCK) -> DataFrame:
    """file, n, n_tokens of each document of the token files in column file; ids after the last separator are one more document.

    Empty files hold no documents. Work is dealt by block; the scan sorts a few numbers a block, per file.
    """

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["file"]:
                s, p = filesystem(uri)
                yield pd.DataFrame({"file": uri, "at": np.arange(0, s.get_file_info(p).size, block, dtype=np.int64)})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, at in batch.itertuples(index=False):
                s, p = filesystem(uri)
                with s.open_input_file(p) as f:
                    ids = np.frombuffer(f.read_at(block, at), "<u2")
                found = np.flatnonzero(ids == separator)
                gaps = np.diff(found) - 1
                first, last = (found[0], len(ids) - 1 - found[-1]) if len(found) else (len(ids), 0)
                yield pd.DataFrame({"file": [uri], "at": [at], "found": [len(found)], "head": [first], "tail": [last], "gaps": [gaps.astype(np.int64)]})

    found_blocks = written(files.select("file").distinct().mapInPandas(blocks, "file string, at long"), "blocks")
    dealt = found_blocks.repartition(max(1, -(-found_blocks.count() // 4)), "file", "at")  # about four blocks a task
    seen = dealt.mapInPandas(scan, "file string, at long, found long, head long, tail long, gaps array<long>")
    order = Window.partitionBy("file").orderBy("at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # A block without separators passes its ids on: run counts those up to here since the last block that had one.
    seen = seen.withColumn("n", F.coalesce(F.sum("found").over(before), F.lit(0))).withColumn("open", F.sum(F.when(F.col("found") == 0, F.col("head")).otherwise(0)).over(order))
    start = F.last(F.when(F.col("found") > 0, F.struct("tail", "open")), ignorenulls=True).over(before)
    seen = seen.withColumn("last", start).withColumn("is_last", F.lead("at").over(order).isNull())
    carried = F.coalesce(F.col("last.tail"), F.lit(0)) + F.col("open") - F.when(F.col("found") == 0, F.col("head")).otherwise(0) - F.coalesce(F.col("last.open"), F.lit(0))
    seen = seen.withColumn("carried", carried)
    closed = seen.where("found > 0").select("file", "n", F.concat(F.array(F.col("carried") + F.col("head")), "gaps").alias("g"))
    counts = closed.select("file", "n", F.posexplode("g").alias("k", "n_tokens")).select("file", (F.col("n") + F.col("k")).alias("n"), "n_tokens")
    rest = F.when(F.col("found") > 0, F.col("tail")).otherwise(F.col("carried") + F.col("head"))
    return counts.unionByName(seen.where("is_last").select("file", (F.col("n") + F.col("found")).alias("n"), rest.alias("n_tokens")).where("n_tokens > 0"))


def token_counts(docs: DataFrame, tokenizer: Callable, separator: int, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens of every row (null text: 0), counted in files that know no documents; one row per input row."""
    names = write_token_files(docs, tokenizer, separator, new_dir(docs.sparkSession, "tokens"), id_col, text_col)
    # Files of names compress to far less than they hold, which would make the planner broadcast them.
    return names.hint("merge").join(count_tokens(names, separator, block), ["file", "n"]).select("doc_id", "n_tokens")
