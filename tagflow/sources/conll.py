"""token<TAB>tag text (a blank line ends a sentence) and label lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagflow.operators.ids import FILE_ORDER, dense_index, file_order
from tagflow.session import scratch

#: Trailing white space of a line, in Unicode's sense.
_TAIL = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+$"
#: The same characters one by one, for Arrow.
_SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(line: Column | str) -> Column:
    """A line without trailing white space (carriage return included)."""
    return F.regexp_replace(F.col(line) if isinstance(line, str) else line, _TAIL, "")


def _split_line(line: Column) -> list[Column]:
    """Token and tag; a line without exactly one tab fails the job, as unpacking does in the reference."""
    parts = F.split(line, "\t", -1)
    ok = F.when(F.size(parts) != 2, F.raise_error(F.concat(F.lit("not token<TAB>tag: "), line))).otherwise(F.get(parts, 0))
    return [ok.alias("token"), F.get(parts, 1).alias("tag")]


def parse_conll_blocks(blocks: DataFrame, block_col: str = "value", id_col: str = "sent_id") -> DataFrame:
    """Sentence blocks (one per row, lines separated by newlines) -> (sent_id, pos, token, tag).

    Lines are right-stripped; lines that are blank then are dropped.
    """
    lines = F.filter(F.transform(F.split(F.col(block_col), "\r\n|\n|\r"), stripped), lambda x: x != "")
    return (blocks.select(id_col, F.posexplode_outer(lines).alias("pos", "_l")).where(F.col("_l").isNotNull())
            .select(id_col, F.col("pos").cast("int").alias("pos"), *_split_line(F.col("_l"))))


LINES = "_split long, _run long, _at long, _l string, _file string, _block long, _runs long, _blanks long, _head boolean, _tail long"


def _numbered_lines(strict: bool):
    """Batches of (value, _file, _block) in the order of the files -> ``LINES``: lines with the number of their run in their split, and their place in it;
    behind each split a row without a line that sums it up.  A run is a sentence's lines; ``strict`` numbers runs by the blank lines before them."""
    def run(batches):
        task, own, state = TaskContext.get().partitionId() << 32, 0, None

        def summary():
            row = {"_split": task + own, "_file": state["file"], "_block": state["block"], "_runs": state["run"], "_blanks": state["blanks"], "_head": state["head"], "_tail": state["at"]}
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema([("_split", pa.int64()), ("_run", pa.int64()), ("_at", pa.int64()), ("_l", pa.string()), ("_file", pa.string()), ("_block", pa.int64()),
                            ("_runs", pa.int64()), ("_blanks", pa.int64()), ("_head", pa.bool_()), ("_tail", pa.int64())])
        for batch in batches:
            if not batch.num_rows:
                continue
            line, files, blocks = (batch.column(k) for k in ("value", "_file", "_block"))
            line = pc.utf8_rtrim(line, _SPACES)
            blank = pc.equal(pc.binary_length(line), 0).to_numpy(zero_copy_only=False)
            ends = sorted({int(e) for c in (files, blocks) for e in pc.run_end_encode(c).run_ends.to_numpy()})
            for lo, hi in zip([0, *ends], ends):
                at_file, at_block = files[lo].as_py(), blocks[lo].as_py()
                if state is None or (state["file"], state["block"]) != (at_file, at_block):
                    if state is not None:
                        yield summary()
                        own += 1
                    state = {"file": at_file, "block": at_block, "run": 0, "blanks": 0, "at": 0, "head": not blank[lo], "open": True}
                b = blank[lo:hi]
                i = np.arange(hi - lo)
                last = np.maximum.accumulate(np.where(b, i, -1))
                at = np.where(last < 0, state["at"] + i, i - last - 1)
                begun = ~b & np.concatenate([[not state["open"]], b[:-1]])
                number = state["run"] + np.cumsum(b if strict else begun)
                state |= {"run": int(number[-1]), "blanks": state["blanks"] + int(b.sum()), "at": int(at[-1]) + 1 if not b[-1] else 0, "open": not b[-1]}
                kept = pa.array(~b)
                n = hi - lo - int(b.sum())
                cols = [pa.array(np.full(n, task + own)), pa.array(number[~b]), pa.array(at[~b]), line.slice(lo, hi - lo).filter(kept)]
                yield pa.RecordBatch.from_arrays(cols + [pa.nulls(n, f.type) for f in list(schema)[4:]], schema=schema)
        if state is not None:
            yield summary()
    return run


def _offsets(splits: list, strict: bool) -> list[tuple]:
    """(_split, number to add to a run, lines of run 0 in splits before, lines are kept up to this run) from the rows that sum up the splits."""
    out, n, before, last = [], 0, 0, {}
    for s in splits:
        if s["_blanks"]:
            last[s["_file"]] = s["_block"]
    file, carry, opened = None, 0, False
    for s in splits:
        if s["_file"] != file:
            file, carry, opened = s["_file"], 0, False
        if strict:
            stop = last.get(file, -1)
            most = None if s["_block"] < stop else s["_runs"] if s["_block"] == stop else 0  # runs below it
            out.append((s["_split"], before, carry, most))
            before += s["_blanks"]
        else:
            new = s["_head"] and not opened
            out.append((s["_split"], n - 1 + new, carry, None))
            n += s["_runs"] + new
        carry = s["_tail"] if s["_blanks"] else carry + s["_tail"]
        opened = carry > 0
    return out


def read_conll(spark: SparkSession, path: str, strict_reference: bool = False) -> DataFrame:
    """Files of token<TAB>tag lines, sentences ended by lines that are blank after stripping -> (sent_id, pos, token, tag).

    The text is read in splits, line by line, wherever files are split.  Each task numbers the sentences of its splits and the lines in them, and writes
    them once with a row that sums up each split; from these rows (one for each split) come the numbers to add.  No line is sorted or shuffled.
    A file's end ends its sentence.  ``sent_id`` counts non-empty sentences from 0 in (file, position) order.
    ``strict_reference``: a last sentence without a blank line behind it is dropped, and empty sentences between consecutive
    blank lines take a number.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    kept = scratch(spark, "conll-lines")
    lines.mapInArrow(_numbered_lines(strict_reference), LINES).write.parquet(kept)
    numbered = spark.read.schema(LINES).parquet(kept)
    splits = numbered.where(F.col("_file").isNotNull()).select("_split", "_file", "_block", "_runs", "_blanks", "_head", "_tail").collect()  # one row for each split
    offsets = _offsets(sorted(splits, key=lambda s: (s["_file"], s["_block"])), strict_reference)
    add = spark.createDataFrame(offsets, "_split long, _add long, _carry long, _most long")
    body = numbered.where(F.col("_file").isNull()).select("_split", "_run", "_at", "_l").join(F.broadcast(add), "_split")
    if strict_reference:
        body = body.where(F.col("_most").isNull() | (F.col("_run") < F.col("_most")))
    first = F.col("_run") == 0
    return body.select((F.col("_run") + F.col("_add")).alias("sent_id"), (F.col("_at") + F.when(first, F.col("_carry")).otherwise(0)).cast("int").alias("pos"),
                       *_split_line(F.col("_l")))


def render_conll(tokens: DataFrame, key: str = "doc_id", tok: str = "tok", tag: str = "tag") -> DataFrame:
    """Inverse of ``parse_conll_blocks``: one block per sequence."""
    seq = F.sort_array(F.collect_list(F.struct("pos", F.concat_ws("\t", tok, tag).alias("line"))))
    return tokens.groupBy(key).agg(seq.alias("_s")).select(
        F.col(key).alias("sent_id"), F.concat(F.array_join(F.col("_s.line"), "\n"), F.lit("\n")).alias("value"))


def write_conll(tokens: DataFrame, path: str, key: str = "doc_id", tok: str = "tok", tag: str = "tag") -> None:
    """Text files of token<TAB>tag lines in key order, a blank line behind each sequence.

    The blocks are written once before they are sorted, as a sort reads its input twice."""
    spark = tokens.sparkSession
    blocks = scratch(spark, "conll-blocks")
    render_conll(tokens, key, tok, tag).write.parquet(blocks)
    spark.read.parquet(blocks).orderBy("sent_id").select("value").write.mode("overwrite").text(path)


def labels_from_lines(lines: DataFrame, line_col: str = "value", order_col: str | list[str] = "line_no",
                      first_id: int = 1, pad: str | None = "<PAD>") -> DataFrame:
    """Non-blank lines in order -> (label, label_id) from ``first_id``; the pad label takes 0."""
    order = [order_col] if isinstance(order_col, str) else list(order_col)
    kept = lines.select(*order, stripped(line_col).alias("label")).where(F.col("label") != "")
    ids = dense_index(kept, order, "label_id", first_id).select("label", F.col("label_id").cast("int"))
    if pad is None:
        return ids
    return ids.unionByName(lines.sparkSession.createDataFrame([(pad, 0)], "label string, label_id int"))


def read_labels(spark: SparkSession, path: str, first_id: int = 1, pad: str | None = "<PAD>") -> DataFrame:
    """A label-per-line file (a small table)."""
    return labels_from_lines(file_order(spark.read.text(path)), order_col=FILE_ORDER, first_id=first_id, pad=pad)
