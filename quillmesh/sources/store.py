"""Tables between the stages of a plan, in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor


def work_dir(spark) -> str:
    """A new folder below spark.checkpoint.dir; only where that is unset (tests, one machine) a local one."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="quillmesh-work")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/design-{uuid.uuid4().hex}"


class Lazy(Mapping):
    """Tables by name, each made when it is first asked for, and once. makers: functions without arguments."""

    def __init__(self, makers: dict[str, Callable]):
        self.makers, self.made, self.locks = makers, {}, {k: threading.RLock() for k in makers}

    def __getitem__(self, name: str):
        with self.locks[name]:
            if name not in self.made:
                self.made[name] = self.makers[name]()
            return self.made[name]

    def __contains__(self, name) -> bool:
        return name in self.makers

    def __iter__(self):
        return iter(self.makers)

    def __len__(self) -> int:
        return len(self.makers)

    def some(self, *names: str) -> list:
        """Several of them, a few made side by side."""
        with ThreadPoolExecutor(6) as pool:
            return list(pool.map(self.__getitem__, names))

    def items(self):
        return dict(zip(self.makers, self.some(*self.makers), strict=True)).items()


class Store:
    """Writes tables below root and returns them read again: a short lineage that survives lost executors."""

    def __init__(self, spark, root: str | None = None):
        self.spark, self.root = spark, root or work_dir(spark)

    def keep(self, name: str, df, apart: str | None = None, **options):
        """apart: a column of few values, each of which is often read by itself."""
        write = df.write.mode("overwrite").options(**options)
        (write.partitionBy(apart) if apart else write).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def table(self, name: str):
        """A table kept before."""
        return self.spark.read.parquet(f"{self.root}/{name}")

    def keep_all(self, tables: dict, **options) -> dict:
        """Several tables at a time, a few jobs side by side; options as in keep."""
        with ThreadPoolExecutor(6) as pool:
            return dict(zip(tables, pool.map(lambda kv: self.keep(*kv, **options), tables.items()), strict=True))

    def drop(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
