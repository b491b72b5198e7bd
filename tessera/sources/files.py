"""Interchange formats: JSON Lines and JSON array sinks, and tolerant readers.

The original passes stages through JSON files (lines for stage 1, one array
per file later). Stages here write JSON Lines or Parquet by language;
``write_json_arrays`` writes the original's arrays, ``read_json_array_split`` reads one
by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import UnsupportedOperationException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.entities import ENTITY_TYPE
from ..operators.ranking import group_positions
from ..session import cut_lineage

# Stage-1 line format: entities are ``[text, label]`` pairs.
NER_RECORD_SCHEMA = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("index", T.LongType()),
        T.StructField("entities", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("lang_code", T.StringType()),
    ]
)

CURATED_CLUSTER = T.StructType(
    [
        T.StructField("cluster_id", T.IntegerType()),
        T.StructField("cluster_size", T.IntegerType()),
        T.StructField("theme", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("titles", T.ArrayType(T.StringType())),
        T.StructField("indices", T.ArrayType(T.LongType())),
    ]
)


def write_jsonl(
    df: DataFrame, path: str, partition_by: Sequence[str] | None = None, fmt: str = "json", mode: str = "overwrite"
) -> None:
    """UTF-8 JSON Lines (or any ``fmt``), optionally partitioned."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def parse_jsonl(lines: DataFrame, schema: T.StructType, line_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """``(good, rejected)`` of JSON lines; every non-blank line is in exactly one.

    The whole schema is parsed before anything is selected, so which lines are
    good never depends on the columns that are read later. ``rejected`` is
    ``line, reason``: ``not_an_object`` (no JSON object at all) or
    ``bad_field`` (an object with a field of another type). Blank and null
    lines are neither. A field that is missing in a line is taken from a column
    of that name, if ``lines`` has one (the partition folder it was read from).
    """
    flagged = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    folder = [f for f in schema.fields if f.name in lines.columns and f.name != line_col]
    rows = lines.where(F.length(F.trim(F.col(line_col))) > 0).select(
        F.col(line_col).alias("line"),
        *[F.col(f.name).cast(f.dataType).alias(f"_in_{f.name}") for f in folder],
        F.from_json(F.col(line_col), flagged, options).alias("r"),
        F.from_json(F.col(line_col), "map<string,string>", {"mode": "PERMISSIVE"}).alias("m"),
    )
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull() | F.col("m").isNull()
    reason = F.when(F.col("m").isNull(), F.lit("not_an_object")).otherwise(F.lit("bad_field"))
    value = {f.name: F.col(f"r.`{f.name}`") for f in schema.fields} | {f.name: F.coalesce(f"r.{f.name}", f"_in_{f.name}") for f in folder}
    return rows.where(~bad).select(*[value[f.name].alias(f.name) for f in schema.fields]), rows.where(bad).select("line", reason.alias("reason"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, reject_path: str | None = None) -> DataFrame:
    """Tolerant JSON Lines read: the good lines; rejected ones go to ``reject_path`` if given.

    Raises if nothing valid is left (the original treats that as an error).
    """
    good, rejected = parse_jsonl(spark.read.text(path), schema)
    if reject_path:
        rejected.write.mode("overwrite").json(reject_path)
    if good.limit(1).count() == 0:
        raise ValueError(f"nothing in {path} could be read as a record")
    return good


def entities_to_pairs(col: str = "entities"):
    return F.transform(F.col(col), lambda e: F.array(e["text"], e["label"]))


def pairs_to_entities(col: str = "entities"):
    return F.transform(F.col(col), lambda p: F.struct(p[0].alias("text"), p[1].alias("label"))).cast(ENTITY_TYPE)


def read_ner_records(spark: SparkSession, path: str, reject_path: str | None = None) -> DataFrame:
    """Stage-1 JSON Lines (any number of files) with entities as structs."""
    return read_jsonl(spark, path, NER_RECORD_SCHEMA, reject_path).withColumn("entities", pairs_to_entities())


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file holding one JSON array of objects, one row per element."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


#: Where a scan stands in a JSON text: outside of strings, inside one, inside one behind a backslash.
OUTSIDE, INSIDE, ESCAPED = range(3)
#: Bytes that are scanned at once.
SCAN_BYTES = 1 << 20


class _Scan:
    """Structure of a piece of JSON text (bytes) that starts in a given state."""

    def __init__(self, data: np.ndarray, state: int) -> None:
        back = data == ord("\\")
        # a character is escaped if an odd run of backslashes ends before it
        at = np.arange(len(data))
        last_other = np.maximum.accumulate(np.where(back, -1, at)) if len(data) else at
        run = np.zeros(len(data) + 1, dtype=np.int64)
        run[1:] = np.where(back, at - last_other, 0)
        head = len(data) if back.all() else int(np.argmin(back))
        if state == ESCAPED:  # a backslash stands before the piece
            run[: head + 1] += 1
        quote = (data == ord('"')) & (run[:-1] % 2 == 0)
        inside = (np.cumsum(quote) + (state != OUTSIDE)) % 2 == 1  # behind each character
        free = ~inside & ~quote
        self.depth = np.cumsum((free & ((data == ord("[")) | (data == ord("{")))).astype(np.int64) - (free & ((data == ord("]")) | (data == ord("}")))))
        self.fall = int(self.depth[-1]) if len(data) else 0
        within = bool(inside[-1]) if len(data) else state != OUTSIDE
        self.end = OUTSIDE if not within else ESCAPED if run[-1] % 2 else INSIDE
        self._free, self._data = free, data

    def cuts(self, depth: int) -> np.ndarray:
        """Places of the characters that separate the elements of the outer array: its brackets and commas."""
        now = self.depth + depth
        d, free = self._data, self._free
        return np.flatnonzero(free & (((now == 1) & ((d == ord(",")) | (d == ord("[")))) | ((now == 0) & (d == ord("]")))))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, value``: the text cut behind every ``}``, read by many tasks, in order inside each byte range."""
    lines = spark.read.option("lineSep", "}").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _ranges_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray]]:
    """``(file, start, bytes)`` of the rows of one byte range, each piece followed by its ``}``; at most
    ``SCAN_BYTES`` at a time, as a scan holds many numbers for each byte."""
    for batch in batches:
        files, starts, values = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2)
        i = 0
        while i < len(files):
            j, held, size = i, [], 0
            while j < len(files) and files[j] == files[i] and starts[j] == starts[i] and size < SCAN_BYTES:
                held.append(values[j].as_py().encode() + b"}")
                j, size = j + 1, size + len(held[-1])
            data = np.frombuffer(b"".join(held), dtype=np.uint8)
            for at in range(0, len(data), SCAN_BYTES):
                yield files[i], int(starts[i]), data[at : at + SCAN_BYTES]
            i = j


def _range_summaries(pieces: DataFrame) -> DataFrame:
    """``file, start, ends, falls``: for each state that a byte range may start in, the state it ends in
    and by how much the depth changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, fall = None, [], []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"file": [key[0]], "start": [key[1]], "ends": [now], "falls": [fall]}, pa.schema([("file", pa.string()), ("start", pa.int64()), ("ends", pa.list_(pa.int32())), ("falls", pa.list_(pa.int64()))]))

        for file, start, data in _ranges_of(batches):
            if (file, start) != key:
                if key is not None:
                    yield row()
                key, now, fall = (file, start), [OUTSIDE, INSIDE, ESCAPED], [0, 0, 0]
            scans = {s: _Scan(data, s) for s in set(now)}
            now, fall = [scans[s].end for s in now], [f + scans[s].fall for s, f in zip(now, fall, strict=True)]
        if key is not None:
            yield row()

    return pieces.mapInArrow(run, "file string, start long, ends array<int>, falls array<long>")


def split_json_array(spark: SparkSession, path: str) -> DataFrame:
    """``file, element string``: the elements of the one JSON array that each file at ``path`` holds.

    A file is read by as many tasks as it has byte ranges. Whether a range starts inside a
    string, and how deep, follows from prefix sums of quotes and brackets over the ranges
    before it: each range is summed up for every state it may start in, the summaries
    (one row a range) are composed in order, and a second pass cuts at the outer
    array's commas. An element that reaches over ranges is joined from its fragments.
    Strings may hold brackets, commas and escaped quotes. Blank elements are none.
    """
    pieces = _pieces(spark, path)
    states, before = {}, {}
    for r in sorted(_range_summaries(pieces).collect()):  # a row for each byte range of a file
        state, depth = before.get(r["file"], (OUTSIDE, 0))
        states[r["file"], r["start"]] = (state, depth)
        before[r["file"]] = (r["ends"][state], depth + r["falls"][state])
    sent = spark.sparkContext.broadcast(states)
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("seq", pa.int64()), ("part", pa.bool_()), ("opens", pa.bool_()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, depth, seq, held, opened = None, OUTSIDE, 0, 0, [], False

        def rows(texts: list[str], part: bool, opens: bool) -> pa.RecordBatch:
            n = len(texts)
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * n), pa.array([key[1]] * n, pa.int64()), pa.array(range(seq, seq + n), pa.int64()), pa.array([part] * n), pa.array([opens] * n), pa.array(texts, pa.string())], schema=schema)

        for file, start, data in _ranges_of(batches):
            if (file, start) != key:
                if key is not None:
                    yield rows([b"".join(held).decode("utf-8", "replace")], True, opened)
                key, seq, held, opened = (file, start), 0, [], False
                state, depth = sent.value[key]
            scan = _Scan(data, state)
            cuts = scan.cuts(depth)
            body = data.tobytes()
            edges = [-1, *cuts.tolist(), len(body)]
            texts = [body[a + 1 : b] for a, b in zip(edges, edges[1:], strict=False)]
            held.append(texts[0])
            if len(texts) > 1:
                done = [b"".join(held), *texts[1:-1]]
                if not opened:  # what stands before the first cut began in an earlier range
                    yield rows([done[0].decode("utf-8", "replace")], True, False)
                    seq, done = seq + 1, done[1:]
                if done:
                    yield rows([t.decode("utf-8", "replace") for t in done], False, True)
                seq, held, opened = seq + len(done), [texts[-1]], True
            state, depth = scan.end, depth + scan.fall
        if key is not None:
            yield rows([b"".join(held).decode("utf-8", "replace")], True, opened)

    cut = cut_lineage(pieces.mapInArrow(run, "file string, start long, seq long, part boolean, opens boolean, text string"))
    order = Window.partitionBy("file").orderBy("start", "seq")  # at most two fragments a range
    parts = cut.where("part").withColumn("number", F.sum(F.col("opens").cast("int")).over(order))
    joined = parts.groupBy("file", "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "seq", "text"))), lambda x: x["text"]), "").alias("text"))
    every = cut.where("NOT part").select("file", "text").union(joined.select("file", "text"))
    # the last piece of a file has no brace of its own: what follows the array says nothing
    return every.where(F.col("text").rlike(r"[^\s}]")).select("file", F.trim("text").alias("element"))


def read_json_array_split(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """:func:`read_json_array` by many tasks, whatever the size of a file: one row per element."""
    return split_json_array(spark, path).select(F.from_json("element", schema).alias("r")).select("r.*")


def write_json_arrays(df: DataFrame, path: str, file_col: str, order_cols: Sequence[str | Column]) -> list[str]:
    """One JSON array per value of ``file_col``, ``path/<value>.json``, in the order given; returns the files.

    Rows are sorted by range and written by many tasks, each record a line with the bracket
    or comma before it that its position asks for, so the pieces of a value put end to end
    are its array. The commit does that: by the file system's own ``concat`` where it
    has one (no byte moves), else by copying through a buffer. Null values go to ``null.json``.
    """
    spark = df.sparkSession
    name = F.coalesce(F.col(file_col).cast("string"), F.lit("null"))
    record = F.to_json(F.struct(*[c for c in df.columns if c != file_col]), {"ignoreNullFields": "false"})
    rows = df.select(name.alias("_file"), record.alias("_record"), *[(F.col(c) if isinstance(c, str) else c).alias(f"_order_{i}") for i, c in enumerate(order_cols)])
    placed = group_positions(rows, ["_file"], [*[f"_order_{i}" for i in range(len(order_cols))], "_record"], pos_col="_pos", size_col="_size")
    line = F.concat(F.when(F.col("_pos") == 0, "[").otherwise(","), "_record", F.when(F.col("_pos") == F.col("_size") - 1, "]").otherwise(""))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    staged = f"{path.rstrip('/')}/_pieces"
    # sorted by the folder's own name, so the writer does not sort again
    ordered = placed.select(F.hex(F.col("_file").cast("binary")).alias("_hex"), "_pos", line.alias("value")).repartitionByRange(parts, "_hex", "_pos").sortWithinPartitions("_hex", "_pos")
    ordered.select("_hex", "value").write.mode("overwrite").partitionBy("_hex").text(staged)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    Path = jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(conf)
    made = []
    for folder in sorted(fs.listStatus(Path(staged)), key=lambda s: s.getPath().getName()):
        label = folder.getPath().getName()
        if not folder.isDirectory() or not label.startswith("_hex="):
            continue
        target = Path(f"{path.rstrip('/')}/{bytes.fromhex(label[5:]).decode().replace('/', '%2F')}.json")
        pieces = sorted((s.getPath() for s in fs.listStatus(folder.getPath())), key=lambda p: p.getName())
        _join_pieces(spark, fs, pieces, target)
        made.append(target.toString())
    fs.delete(Path(staged), True)
    return made


def _join_pieces(spark: SparkSession, fs, pieces: list, target) -> None:
    """Put files end to end, the first one becoming ``target``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs.delete(target, False)
    if len(pieces) == 1:
        fs.rename(pieces[0], target)
        return
    try:
        others = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(pieces) - 1)
        for i, p in enumerate(pieces[1:]):
            others[i] = p
        fs.concat(pieces[0], others)
        fs.rename(pieces[0], target)
    except UnsupportedOperationException:
        out = fs.create(target, True)
        try:
            for p in pieces:
                source = fs.open(p)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
                source.close()
        finally:
            out.close()


def read_curated_points(spark: SparkSession, path: str) -> DataFrame:
    """Curated result object ``{lang: [cluster, ...]}`` exploded to rows.

    Output: ``lang, cluster_id, cluster_size, theme, description, titles, indices``.
    """
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", T.MapType(T.StringType(), T.ArrayType(CURATED_CLUSTER))).alias("m"))
    return parsed.select(F.explode("m").alias("lang", "clusters")).select(
        "lang", F.explode("clusters").alias("c")
    ).select("lang", "c.*")


def curated_member_rows(curated: DataFrame) -> DataFrame:
    """Long form ``(lang, cluster_id, member_pos, title, idx)`` of curated clusters."""
    return curated.select(
        "lang", "cluster_id", F.posexplode(F.arrays_zip("titles", "indices")).alias("member_pos", "m")
    ).select("lang", "cluster_id", "member_pos", F.col("m.titles").alias("title"), F.col("m.indices").alias("idx"))
