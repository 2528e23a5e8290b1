"""The compiled token coder: TokenCodec.java, compiled by Janino, which Spark brings, and sent to the executors as a jar."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_NAME = "pairloom_token_codec"
_known: set[str] = set()


def register(spark: SparkSession) -> None:
    """Makes the session know the function."""
    own = spark.sparkContext.applicationId
    jvm = spark.sparkContext._jvm
    if own not in _known:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook((Path(__file__).parent / "TokenCodec.java").read_text())
        folder = os.path.realpath(tempfile.mkdtemp(prefix="pairloom-jar-"))
        atexit.register(shutil.rmtree, folder, True)
        with zipfile.ZipFile(f"{folder}/pairloom_codec.jar", "w") as z:
            for name, code in dict(compiler.getBytecodes()).items():
                z.writestr(name.replace(".", "/") + ".class", bytes(code))
        spark.sparkContext._jsc.addJar(f"{folder}/pairloom_codec.jar")
        register.classes = compiler.getClassLoader()
        _known.add(own)
    made = register.classes.loadClass("pairloom.TokenCodec").getDeclaredConstructors()[0].newInstance(None)
    kind = jvm.org.apache.spark.sql.types.DataType.fromJson('"binary"')
    spark._jsparkSession.udf().register(_NAME, made, kind)


def encoded(places: str, ids: str, counts: str) -> Column:
    return F.call_function(_NAME, F.lit(True), F.col(places), F.col(ids), F.col(counts))


def decoded(blocks: str, ids: str, counts: str) -> Column:
    return F.call_function(_NAME, F.lit(False), F.col(blocks), F.col(ids), F.col(counts))
