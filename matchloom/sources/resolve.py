"""Finding inputs by name; Hadoop's file system is asked, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.quality import QualityError

#: Preferred names of the user table.
STEM = "career_match_20_resumes_with_generated_interests"
PREFERRED = (f"{STEM}(2).csv", f"{STEM}.csv")
SUBFOLDER = "Career Profile Files"


def _files(spark: SparkSession, folder: str) -> list[str]:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(conf)
    if not store.exists(path):
        return []
    found, files = [], store.listFiles(path, True)
    while files.hasNext():
        found.append(files.next().getPath().toString())
    return sorted(found)


def find_input(spark: SparkSession, folder: str, names=PREFERRED) -> str:
    """The one file below the folder with the first name that any has; several or none is an error."""
    files = _files(spark, folder)
    for name in names:
        matches = [f for f in files if f.rsplit("/", 1)[-1] == name]
        if len(matches) == 1:
            return matches[0]
        if matches:
            raise QualityError("multiple input files found; name one")
    raise QualityError(f"no {names[-1]} below {folder}; name an input")


def only_one(spark: SparkSession, folder: str, name: str) -> str:
    """The file in the folder or its subfolder of catalogue files, which must not be in both."""
    wanted = {f"{p}/{name}" for p in (folder.rstrip("/"), f"{folder.rstrip('/')}/{SUBFOLDER}")}
    found = [f for f in _files(spark, folder) if any(f.removeprefix("file:").replace("//", "/").endswith(w.removeprefix("file:").replace("//", "/")) for w in wanted)]
    if len(found) != 1:
        raise QualityError(f"expected exactly one {name}; found {len(found)}")
    return found[0]
