"""The sweep of configurations inside Spark's JVM, as a function of columns.

NumPy advances streams in step at tens of array operations a bit; Sweep.java does one stream at a time, with the same
numbers. Spark's own compiler (Janino) compiles it; executors get the classes as a jar of the session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quernstone.functions import coder
from quernstone.operators.seqstats import SQUASH

_KINDS = {"word": 100, "pair": 101, "column": 102, "literal": 103}
_jar: list[str] = []


def covers(configs: list[coder.Config]) -> bool:
    """Whether Sweep has what the configurations ask for, and may price them together."""
    c = configs[0]
    known = c.column in ("", "real") and c.literal in ("", "real") and c.third in ("", "order2") and not (c.word_class or c.stem or c.sparse or c.by_distance)
    return known and coder._plain(c) and all(coder._kept(x) == coder._kept(c) for x in configs)


def _spec(configs: list[coder.Config]) -> str:
    """The configurations for Sweep: what they have in common, all experts, and of each its learning rate and inputs."""
    c, known = configs[0], {}
    own = [[known.setdefault((n, k + 1, r), len(known)) for k, (n, r) in enumerate(x.experts())] for x in configs]
    e, m = len(known), len(c.matches)
    roster = [v for n, salt, r in known for v in (_KINDS[n] if n in _KINDS else int(n[1:]), salt, r)]
    rows = (SQUASH, [c.scale], [coder.COLD_WEIGHT], c.apm_rates, [c.third], [v for t in c.matches for v in t], roster, [x.mixer_rate for x in configs])
    return "|".join([*(",".join(map(str, r)) for r in rows), ";".join(",".join(map(str, [*o, *range(e, e + m)])) for o in own)])


def _jar_of(spark: SparkSession) -> str:
    """Path of a jar with the compiled classes, made once."""
    if not _jar:
        compiler = spark.sparkContext._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(Path(__file__).with_name("Sweep.java").read_text())
        path = f"{tempfile.mkdtemp(prefix='quernstone-jar-')}/quernstone-sweep.jar"
        with zipfile.ZipFile(path, "w") as z:
            for name, code in dict(compiler.getBytecodes()).items():
                z.writestr(name.replace(".", "/") + ".class", bytes(code))
        _jar.append(path)
    return _jar[0]


def swept(spark: SparkSession, data: Column, configs: list[coder.Config]) -> Column:
    """Of binary data an array of the bits that it costs by each configuration, as coder.sweep gives them."""
    spark.sql(f"ADD JAR '{_jar_of(spark)}'")
    kind = spark._jsparkSession.parseDataType(ArrayType(DoubleType()).json())
    spark._jsparkSession.udf().register("quernstone_sweep", spark.sparkContext._jvm.quernstone.Sweep(), kind)
    return F.call_function("quernstone_sweep", data, F.lit(_spec(configs)))
