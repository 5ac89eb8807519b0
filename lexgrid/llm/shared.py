"""What the operators have in common: the shared folder, written tables, word patterns."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.sources.store import shared_folder

#: Fixed values of the contracts: what separates words, as characters and as a pattern.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]++"
#: Rows of the Arrow batches that Python gets.
ARROW_ROWS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/lexgrid/{uuid.uuid4().hex}/{name}"


def uri(spark: SparkSession, path: str) -> str:
    """path with its scheme, as Spark would resolve it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return full if "://" in full else full.replace(":/", ":///", 1)


def file_system(path: str):
    """(file system, path in it) of a URI, for Python on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


_shipped: set[str] = set()


def for_python(spark: SparkSession) -> None:
    """Before Python runs on executors: they get this package, and the session batches of few rows, for texts can be long. The setting stays, for returned tables are computed later; a lower one of the user's holds."""
    if int(spark.conf.get(ARROW_ROWS)) > BATCH_ROWS:
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))
    if (app := spark.sparkContext.applicationId) not in _shipped:
        top = Path(__file__).resolve().parents[1]
        made = Path(tempfile.mkdtemp(prefix="lexgrid-code-")) / "lexgrid_code.zip"
        with zipfile.ZipFile(made, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(made))
        _shipped.add(app)


class Known(dict):
    """A generation of words; what isn't in it comes from `find`."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, word):
        return self.find(word)


class Words:
    """A bounded memory of words in two generations: when the new one holds half of `most`, it becomes the old one; words that are met again come back from there."""

    def __init__(self, most: int):
        self.most, self.old, self.new = most, {}, {}
        self.make, self.longest = None, 0

    def made_by(self, make, longest: int) -> Words:
        """`new` makes missing words itself, and keeps them if they are no longer than `longest`."""
        if self.make is None:
            self.make, self.longest, self.new = make, longest, Known(self.find)
        return self

    def empty(self) -> dict:
        """A new generation: a plain dict, unless it makes missing words."""
        return Known(self.find) if self.make else {}

    def find(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= self.longest:
            self.new[word] = value
        return value

    def turned(self) -> Words:
        """Itself, where `new` has room."""
        if len(self.new) > self.most // 2:
            self.old, self.new = self.new, self.empty()
        return self

    def unknown(self, words: list) -> list:
        """The distinct words that aren't in `new` and must be put there; others are, after this."""
        missing = set(words).difference(self.new)
        if not missing:
            return []
        if len(self.new) + len(missing) > self.most // 2:
            self.old, self.new = self.new, self.empty()
            missing = set(words)
        back = {w: self.old[w] for w in missing if w in self.old}
        self.new.update(back)
        return [w for w in missing if w not in back]

    def clear(self) -> None:
        self.new, self.old = self.empty(), {}


_held: dict[str, Words] = {}


def memory_of(name: str, most: int = 0) -> Words:
    """A worker's memory of words for one operator. Workers live on from stage to stage, so that the others' memories are emptied when another operator asks, and the pages go back to the system."""
    full = [words for other, words in _held.items() if other != name and (words.new or words.old)]
    for words in full:
        words.clear()
    if full:
        trimmed()
    return _held.setdefault(name, Words(most))


def trimmed() -> None:
    """Give freed memory back, where the C library can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Settings while a table is written: shuffle files go when it is there, whatever still refers to the plan.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Row groups of scratch tables, small for the writers' memory.
ROW_GROUP = 16 << 20
_scratch: list[list[DataFrame]] = []


def written(df: DataFrame, name: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """df as a table in the shared folder, read again: work is done once and lost executors cost only a read. batch_rows: of the Arrow batches that Python gets, for rows can be large. The session's settings are afterwards as before."""
    spark, schema = df.sparkSession, df.schema
    with settings(spark, _WRITING | {ARROW_ROWS: str(batch_rows)}):
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path := fresh_path(spark, name))
    out = spark.read.schema(schema).parquet(path)
    out._written_at = path
    if _scratch:
        _scratch[-1].append(out)
    return out


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """The session has these settings within, and its own again afterwards."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def scratch():
    """Tables written within are deleted at the end, but for those given to the yielded function; these belong to the scratch around it, if there is one."""
    kept: list[DataFrame] = []
    _scratch.append([])
    try:
        yield lambda *tables: (kept.extend(tables), tables[0])[1]
    finally:
        made = _scratch.pop()
        dropped(*[t for t in made if not any(t is k for k in kept)])
        if _scratch:
            _scratch[-1].extend(kept)


def dropped(*tables: DataFrame) -> None:
    """Delete written() tables that nothing will read again."""
    for t in tables:
        at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written_at)
        at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the driver's. Its rows go to the JVM as Arrow; a list given to createDataFrame would start Python workers of a second kind, which stay."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows, strict=True)) or [()] * len(kind)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def lower_az(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def as_row(docs: DataFrame, **more: Column) -> DataFrame:
    """docs' rows as one column `row`, in which no name can clash, and more columns beside it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(name) for name, c in more.items()])


def of_row(columns: list[str], drop: tuple[str, ...] = ()) -> list[Column]:
    """The columns of as_row() again, but for those of the names in `drop`."""
    return [F.col(f"row.`{c}`").alias(c) for c in columns if c.lower() not in drop]


def tie_order(docs: DataFrame, text: str = "text") -> list[Column]:
    """What puts the rows of as_row(docs) in order that agree in an id, alike in every run: a hash of the text, then all other columns."""
    return [*([F.xxhash64(f"row.`{text}`")] if text in docs.columns else []), F.to_json(F.struct(F.lit(0).alias("_"), *[F.col(f"row.`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text]))]


def of_row_with_text(docs: DataFrame, new: Column, text: str = "text", drop: tuple[str, ...] = ()) -> list[Column]:
    """The columns of as_row(docs) with another text, and n_chars to match where that column exists; no other column changes."""
    swap = {text: new} | ({"n_chars": F.length(new).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns and text != "n_chars" else {})
    return [swap[c].alias(c) if c in swap else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in drop]
