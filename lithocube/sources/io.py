"""Reading and writing: logs, feature cubes, feature sets, point lists, run logs."""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithocube.functions.scalars import is_header, name_of_file

#: Lines that a run writes about an iteration, as pattern and names of its groups.
RUN_LINES = {
    "expected": (r"Iteration best features: (.*) with errors: MAE ([-\d.eE+]+) RMSE ([-\d.eE+]+)", ("features", "mae", "rmse")),
    "test": (r"Test errors: RMSE: ([-\d.eE+]+) MAE: ([-\d.eE+]+)", ("rmse", "mae")),
    "wells": (r"Test wells performance: RMSE: (.*) MAE: (.*)", ("rmse", "mae")),
    "times": (r"Iteration total time\(s\): ([-\d.eE+]+)", ("seconds",)),
}


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table with a header line; NaN, in any case, and empty cells are null."""
    return spark.read.csv(path, header=True, schema=schema, nanValue="NaN", enforceSchema=False)


def read_plain(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log without header, its columns apart by blanks."""
    return spark.read.csv(path, sep=" ", schema=schema, ignoreLeadingWhiteSpace=True)


def read_logs_of(spark: SparkSession, glob: str, schema: str, wells: DataFrame, name: str = "well") -> DataFrame:
    """All files whose name is that of one of `wells`, with column `well`."""
    logs = spark.read.csv(glob, header=True, schema=schema).select("*", name_of_file(F.col("_metadata.file_name")).alias("well"))
    return logs.join(wells.select(F.upper(name).alias("well")).distinct(), "well", "left_semi")


def read_las(spark: SparkSession, path: str) -> DataFrame:
    """file, line, values array of LAS logs: the numbers of the lines after the data mark; the header's null value is null.

    Files are read whole, one per row, as the format has its layout in its head; a file is one well.
    """

    def parse(batches):
        for pdf in batches:
            out = []
            for path_, content in zip(pdf["path"], pdf["content"]):
                data, null, n = False, None, 0
                for line in content.decode("latin-1").splitlines():
                    s = line.strip()
                    if s.upper().startswith("NULL"):
                        null = float(s.split(".", 1)[1].split(":")[0].split()[-1])
                    elif s.upper().startswith("~A"):
                        data = True
                    elif data and s and not s.startswith("#"):
                        values = [float(t) for t in s.split()]
                        out.append((path_, n, [None if v == null else v for v in values]))
                        n += 1
            yield pd.DataFrame(out, columns=["file", "line", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "file string, line int, values array<double>")


def depth_range(las: DataFrame) -> DataFrame:
    """file, first and last depth."""
    return las.groupBy("file").agg(F.min(F.get("values", F.lit(0))).alias("first"), F.max(F.get("values", F.lit(0))).alias("last"))


#: Bytes of a file that one task reads.
RANGE = 64 << 20


def _ranges(spark: SparkSession, path: str, size: int) -> DataFrame:
    """path, at: the stretches of `size` bytes that files are read in, spread over tasks; no content is read here."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    r = files.select("path", F.explode(F.sequence(F.lit(0), F.floor(F.col("length") / size))).alias("k"))
    n = r.count()
    return r.select("path", (F.col("k") * size).alias("at")).repartition(max(1, min(n, 10_000)))


def _open(path: str) -> Any:
    """A file that can be sought in, on any file system that Arrow knows."""
    from pyarrow import fs

    where = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path
    system, name = fs.FileSystem.from_uri(where) if "://" in where else (fs.LocalFileSystem(), where)
    return system.open_input_file(name)


def _stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def read_npy(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """feature, x, y, amp: 3-D arrays in .npy files as traces; the feature is the file's stem.

    Files are read in stretches of `size` bytes, so a large cube is many tasks. Arrays in column order are an error.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path_, at in zip(pdf["path"], pdf["at"]):
                with _open(path_) as f:
                    version = np.lib.format.read_magic(f)
                    shape, fortran, kind = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
                    if len(shape) != 3 or fortran or kind.hasobject:
                        raise ValueError(f"{path_}: not a cube of numbers in row order")
                    first, length, count = f.tell(), shape[2] * kind.itemsize, shape[0] * shape[1]
                    lo, hi = (min(count, max(0, -(-(p - first) // max(length, 1)))) for p in (at, at + size))
                    step = max(1, (8 << 20) // max(length, 1))
                    for i in range(lo, hi, step):
                        j = min(i + step, hi)
                        f.seek(first + i * length)
                        rows = np.frombuffer(f.read((j - i) * length), kind).reshape(j - i, shape[2]).astype(float)
                        k = np.arange(i, j)
                        yield pd.DataFrame({"feature": _stem(path_), "x": k // shape[1], "y": k % shape[1], "amp": list(rows)})

    return _ranges(spark, path, size).mapInPandas(parse, "feature string, x int, y int, amp array<double>")


def write_npy(traces: DataFrame, path: str, shape: tuple[int, int, int], kind: str = "<f8") -> None:
    """Traces (x, y, amp) as one .npy cube: the file is laid out first, every task then writes its own traces in place.

    `path` is a file in a folder that all executors share as a file system. A task that is run again writes the same
    bytes. Missing traces stay 0.
    """
    np.lib.format.open_memmap(path, mode="w+", dtype=np.dtype(kind), shape=shape).flush()

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cube = np.lib.format.open_memmap(path, mode="r+")
        n = 0
        for pdf in batches:
            for x, y, amp in zip(pdf["x"], pdf["y"], pdf["amp"]):
                cube[x, y, : len(amp)] = amp
            n += len(pdf)
        cube.flush()
        yield pd.DataFrame({"n": [n]})

    traces.select("x", "y", "amp").mapInPandas(put, "n long").agg(F.sum("n")).collect()


def read_points_npy(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z, phi of two-dimensional .npy point lists."""

    def parse(batches):
        for pdf in batches:
            for content in pdf["content"]:
                a = np.load(io.BytesIO(content), allow_pickle=False)
                yield pd.DataFrame({"x": a[:, 0].astype(int), "y": a[:, 1].astype(int), "z": a[:, 2].astype(int), "phi": a[:, 3].astype(float)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "x int, y int, z int, phi double")


def ibm_floats(raw: np.ndarray) -> np.ndarray:
    """Hexadecimal floating point of big-endian 32-bit words."""
    v = raw.astype(np.uint32)
    sign = np.where(v >> 31, -1.0, 1.0)
    exponent = ((v >> 24) & 0x7F).astype(float) - 64
    return sign * (v & 0x00FFFFFF).astype(float) / 2**24 * 16.0**exponent


def read_segy(spark: SparkSession, path: str, crosslines: int, size: int = RANGE) -> DataFrame:
    """file, x, y, amp: SEG-Y traces as a cube of `crosslines` columns; trace i lies at (i div crosslines, i mod crosslines).

    Sample formats 1 (hexadecimal) and 5 (IEEE). A number of traces that the crosslines do not divide is an error.
    Traces of a file are all of one length, so a task finds those of its stretch of `size` bytes by arithmetic.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path_, at in zip(pdf["path"], pdf["at"]):
                with _open(path_) as f:
                    head = f.read(3600)[3200:]
                    n, form = int.from_bytes(head[20:22], "big"), int.from_bytes(head[24:26], "big")
                    length = 240 + 4 * n
                    count, rest = divmod(f.size() - 3600, length)
                    if rest or count % crosslines:
                        raise ValueError(f"{path_}: {count} traces are not whole lines of {crosslines}")
                    lo, hi = (min(count, max(0, -(-(p - 3600) // length))) for p in (at, at + size))
                    step = max(1, (8 << 20) // length)
                    for i in range(lo, hi, step):
                        j = min(i + step, hi)
                        f.seek(3600 + i * length)
                        body = np.frombuffer(f.read((j - i) * length), np.uint8).reshape(j - i, length)[:, 240:].copy()
                        amp = ibm_floats(body.view(">u4")) if form == 1 else body.view(">f4").astype(float)
                        k = np.arange(i, j)
                        yield pd.DataFrame({"file": path_, "x": k // crosslines, "y": k % crosslines, "amp": list(amp)})

    return _ranges(spark, path, size).mapInPandas(parse, "file string, x int, y int, amp array<double>")


def write_segy(traces: DataFrame, path: str, shape: tuple[int, int, int], step_us: int = 4000) -> None:
    """Traces (x, y, amp) as one SEG-Y file of IEEE samples, written in place as write_npy does."""
    nx, ny, nz = shape
    head = bytearray(3600)
    head[3216:3218], head[3220:3222], head[3224:3226] = step_us.to_bytes(2, "big"), nz.to_bytes(2, "big"), (5).to_bytes(2, "big")
    length = 240 + 4 * nz
    with open(path, "wb") as f:
        f.write(bytes(head))
        f.truncate(3600 + nx * ny * length)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        with open(path, "r+b") as f:
            for pdf in batches:
                for x, y, amp in zip(pdf["x"], pdf["y"], pdf["amp"]):
                    i = int(x) * ny + int(y)
                    mark = bytearray(240)
                    mark[0:4], mark[114:116], mark[188:192], mark[192:196] = (i + 1).to_bytes(4, "big"), nz.to_bytes(2, "big"), int(x).to_bytes(4, "big"), int(y).to_bytes(4, "big")
                    samples = np.zeros(nz, ">f4")
                    samples[: len(amp)] = amp
                    f.seek(3600 + i * length)
                    f.write(bytes(mark) + samples.tobytes())
                n += len(pdf)
        yield pd.DataFrame({"n": [n]})

    traces.select("x", "y", "amp").mapInPandas(put, "n long").agg(F.sum("n")).collect()


def write_training_dump(points: DataFrame, path: str, *names: str) -> None:
    """Training rows as text, one list of (target, feature values) a line, as write_csv does for tables."""
    row = F.concat(F.lit("("), F.concat_ws(", ", *[F.col(n).cast("string") for n in names]), F.lit(")"))
    points.select(row.alias("value")).write.mode("overwrite").text(path)


def read_training_dump(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Columns of numbers of a text of (a, b, ...) rows; what is no number is null."""
    t = F.split(F.regexp_replace(F.trim("value"), r"^\(|\)$", ""), r",\s*")
    return spark.read.text(path).where("trim(value) <> ''").select(*[F.get(t, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names)])


def around_wells(points: DataFrame, wells: list[tuple[int, int, int]], reach: int) -> DataFrame:
    """Points (x, y and others) within the square of `reach` around a well (well_id, x, y), once per well; wells are a
    short list of settings."""
    near = F.array_compact(F.array(*[F.when((F.abs(F.col("x") - wx) <= reach) & (F.abs(F.col("y") - wy) <= reach), F.lit(w)) for w, wx, wy in wells]))
    return points.withColumn("well_id", F.explode(near))


def read_feature_sets(spark: SparkSession, path: str) -> DataFrame:
    """set (file and line order), rank, feature, dx, dy, dz of files that hold one list of (name, (dx, dy, dz)) per line."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("set", "line")).where("trim(line) <> ''")
    return feature_sets(lines)


def feature_sets(lines: DataFrame) -> DataFrame:
    """The same from rows (set, line)."""
    item = r"\('([^']+)', \(?(-?\d+), (-?\d+), (-?\d+)\)?\)"
    parts = F.arrays_zip(*[F.regexp_extract_all("line", F.lit(item), F.lit(i)).alias(f"g{i}") for i in range(1, 5)])
    e = lines.select("set", F.posexplode(parts).alias("rank", "p"))
    return e.select("set", "rank", F.col("p.g1").alias("feature"), *[F.col(f"p.g{i}").cast("int").alias(d) for i, d in ((2, "dx"), (3, "dy"), (4, "dz"))])


def read_numbers(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Columns of numbers apart by blanks, commas or semicolons; header lines are known by having no number."""
    lines = spark.read.text(path).where(~is_header(F.col("value")) & (F.trim("value") != ""))
    t = F.split(F.trim("value"), r"[\s,;]+")
    return lines.select(*[F.get(t, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names)])


def run_metrics(lines: DataFrame, kind: str, line: str = "value") -> DataFrame:
    """iteration and the values of one kind of line of a run's log (see RUN_LINES), each once."""
    pattern, names = RUN_LINES[kind]
    iteration = F.regexp_extract(line, r"\[it(\d+)\]", 1).try_cast("int")
    got = lines.where(F.col(line).rlike(pattern)).select(iteration.alias("iteration"), *[F.regexp_extract(line, pattern, i + 1).alias(n) for i, n in enumerate(names)])
    numbers = [n for n in names if n != "features" and kind != "wells"]
    return got.withColumns({n: F.col(n).try_cast("double") for n in numbers}).distinct()


def feature_catalog(spark: SparkSession, glob: str, first: int | None = None) -> DataFrame:
    """feature and path of every file, by name; the first so many only, if asked."""
    files = spark.read.format("binaryFile").load(glob).select("path")
    c = files.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("feature"), "path")
    return c if first is None else c.orderBy("feature").limit(first)


def write_features(traces: DataFrame, path: str, pieces: int | None = None) -> None:
    """Traces by feature: each feature is a partition that is read alone, in `pieces` files of neighbouring lines
    (by default as many as the session's shuffles have, where a feature has so many lines)."""
    pieces = pieces or int(traces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lying = traces.withColumn("_p", F.floor(F.col("x") / 32)).repartition(pieces, "feature", "_p").sortWithinPartitions("feature", "x", "y").drop("_p")
    lying.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feature").parquet(path)


def read_features(spark: SparkSession, path: str, *names: str) -> DataFrame:
    t = spark.read.parquet(path)
    return t.where(F.col("feature").isin(*names)) if names else t


def write_csv(df: DataFrame, path: str) -> None:
    """Point lists and logs, with header, sorted by x, y, z where they have them within each file."""
    order = [c for c in ("x", "y", "z") if c in df.columns]
    (df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df).write.mode("overwrite").csv(path, header=True)
