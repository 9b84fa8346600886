"""Results by case, kept with what they were computed from.

A store is a folder of data parts, never overwritten, and of manifests: each a full list of cases with the
fingerprint of their inputs and the part that holds their rows, and the settings of the run. A manifest is one
file, written after its data; the newest one is the state. A run that breaks off before leaves the old state as
it was, a case is computed again only when its inputs or the settings changed, and readers see rows and
settings of one and the same run.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, commit string, case string, fingerprint string, part string, settings string"


def fingerprints(inputs: DataFrame, by: str) -> DataFrame:
    """(case, fingerprint): a digest of each case's rows, whatever their order and partitioning; repeated rows count.

    Columns count by name and type. Sums of two 64-bit hashes and the number of rows tell tables apart.
    """
    columns = sorted(c for c in inputs.columns if c != by)
    schema = ",".join(f"{c} {inputs.schema[c].dataType.simpleString()}" for c in columns)
    nulls = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in columns]) if columns else F.lit("")
    total = [F.sum(F.xxhash64(F.lit(salt), nulls, *columns).cast("decimal(38,0)")).cast("string") for salt in (1, 2)]
    text = F.concat_ws(":", F.lit(schema), F.count("*").cast("string"), *total)
    return inputs.groupBy(F.col(by).cast("string").alias("case")).agg(F.sha2(text, 256).alias("fingerprint"))


class CaseStore:
    """The results under ``folder``; ``column`` names the case in their rows."""

    def __init__(self, spark: SparkSession, folder: str, column: str = "scenario") -> None:
        self.spark, self.folder, self.column = spark, folder.rstrip("/"), column

    def manifest(self) -> DataFrame:
        """(version, commit, case, fingerprint, part, settings) of the state; no rows before the first run."""
        try:
            files = self.spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").json(f"{self.folder}/manifest")
        except AnalysisException:
            return self.spark.createDataFrame([], MANIFEST)
        newest = F.struct("version", "commit")
        return files.where(newest == files.agg(F.max(newest)).scalar())

    def settings(self) -> dict:
        """Settings of the run that the state comes from."""
        row = self.manifest().select("settings").first()
        return json.loads(row["settings"]) if row else {}

    def read(self) -> DataFrame:
        """Rows of all cases of the state; the parts of earlier states are not touched."""
        state = self.manifest().where("part is not null").select("case", "part").collect()  # names, a row for each case
        if not state:
            raise ValueError(f"{self.folder} holds no finished case")
        parts: dict[str, list[str]] = {}
        for row in state:
            parts.setdefault(row["part"], []).append(row["case"])
        out = None
        for part, cases in sorted(parts.items()):
            rows = self.spark.read.parquet(f"{self.folder}/data/{part}").withColumn(self.column, F.col(self.column).cast("string"))
            rows = rows.where(F.col(self.column).isin(cases))
            out = rows if out is None else out.unionByName(rows)
        return out

    def update(self, inputs: Mapping[str, str], compute: Callable[[list[str]], DataFrame], settings: Mapping[str, object] | None = None,
               *, keep_others: bool = True) -> list[str]:
        """Compute the cases whose fingerprint is new, in one job, then commit; returns their names.

        inputs: fingerprint of each case. ``compute`` gets names and returns one table with ``column``; a case without
        rows is finished all the same. Other settings than the state's recompute every case. Cases that are not
        in ``inputs`` stay unless ``keep_others`` is off. Of two runs at a time one state wins as a whole, nothing is mixed.
        """
        text = json.dumps(dict(settings or {}), sort_keys=True)
        state = {r["case"]: r for r in self.manifest().collect()}
        same = [r for r in state.values() if r["settings"] == text and r["part"] is not None]
        known = {r["case"]: (r["fingerprint"], r["part"]) for r in same}
        missing = [c for c, print_ in inputs.items() if known.get(c, (None,))[0] != print_]
        rows = {c: known[c] for c in known if c in inputs or keep_others}
        if missing:
            part = uuid.uuid4().hex
            made = compute(missing)
            made.write.partitionBy(self.column).parquet(f"{self.folder}/data/{part}")
            rows |= {c: (inputs[c], part) for c in missing}
        if missing or set(rows) != set(state):
            self._commit(1 + max((r["version"] for r in state.values()), default=0), rows, text)
        return missing

    def _commit(self, version: int, rows: Mapping[str, tuple[str, str]], settings: str) -> None:
        commit = uuid.uuid4().hex
        table = [(version, commit, case, print_, part, settings) for case, (print_, part) in sorted(rows.items())]
        # A state without cases still has a version and settings.
        frame = self.spark.createDataFrame(table or [(version, commit, None, None, None, settings)], MANIFEST)
        frame.coalesce(1).write.mode("error").json(f"{self.folder}/manifest/{version:09d}-{commit}")


def stale(store: CaseStore, inputs: DataFrame, by: str) -> DataFrame:
    """(case, reason): cases whose inputs are new, changed or gone, without computing anything."""
    state = store.manifest().where("case is not null").select("case", F.col("fingerprint").alias("_old"))
    both = fingerprints(inputs, by).join(state, "case", "full")
    reason = F.when(F.col("_old").isNull(), "new").when(F.col("fingerprint").isNull(), "gone").when(F.col("fingerprint") != F.col("_old"), "changed")
    return both.select("case", reason.alias("reason")).where("reason is not null")


def prints(inputs: DataFrame, by: str, cases: Sequence[str]) -> dict[str, str]:
    """Fingerprints of the named cases for :meth:`CaseStore.update`; a case without input rows has that of no rows."""
    found = {r["case"]: r["fingerprint"] for r in fingerprints(inputs.where(F.col(by).cast("string").isin(list(cases))), by).collect()}
    return {c: found.get(c, "no rows") for c in cases}
