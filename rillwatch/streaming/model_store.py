"""Versions of the two models in a shared folder, swapped while a stream runs.

A version is written whole and then published by an empty file whose creation is atomic: ``published/0000000002``. Readers take the
highest number, so they see a version complete or not at all. The driver of a stream asks once per micro-batch and loads a version once;
its trees are shipped to the executors once per version, with the first batch that uses it.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from ..errors import ModelError
from ..operators.bagging import BaggedForest
from ..operators.classify import Classifier
from ..operators.forest import Forest
from ..operators.spread_forest import SpreadForest

_FORESTS = {"forest": Forest, "spread": SpreadForest}


class ModelStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._loaded: tuple[int, Forest | None, Classifier | BaggedForest | None] | None = None

    def _file(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Published versions, ascending."""
        folder, files = self._file("published")
        return sorted(int(s.getPath().getName()) for s in files.listStatus(folder)) if files.exists(folder) else []

    def publish(self, forest: Forest | None, classifier: Classifier | BaggedForest | None = None) -> int:
        """Write the models as the next version and let readers have it; None keeps the model of the last version."""
        before = self.versions()
        if before and (forest is None or classifier is None):
            _, old_forest, old_classifier = self.load(before[-1])
            forest, classifier = forest or old_forest, classifier or old_classifier
        version = (before[-1] if before else 0) + 1
        at, kinds = f"{self.path}/v{version}", {}
        if forest is not None:
            kinds["forest"] = "spread" if isinstance(forest, SpreadForest) else "forest"
            forest.save(self.spark, f"{at}/forest")
        if classifier is not None:
            kinds["classifier"] = "bagged" if isinstance(classifier, BaggedForest) else "mllib"
            classifier.save(f"{at}/classifier")
        self.spark.createDataFrame([(json.dumps(kinds),)], "kinds string").coalesce(1).write.mode("overwrite").text(f"{at}/kinds")
        mark, files = self._file(f"published/{version:010d}")
        files.mkdirs(mark.getParent())
        if not files.createNewFile(mark):
            raise ModelError(f"version {version} was published by another writer")
        return version

    def load(self, version: int) -> tuple[int, Forest | None, Classifier | BaggedForest | None]:
        if self._loaded is None or self._loaded[0] != version:
            at = f"{self.path}/v{version}"
            kinds = json.loads(self.spark.read.text(f"{at}/kinds").first()[0])
            forest = _FORESTS[kinds["forest"]].load(self.spark, f"{at}/forest") if "forest" in kinds else None
            if "classifier" not in kinds:
                classifier = None
            elif kinds["classifier"] == "bagged":
                classifier = BaggedForest.load(self.spark, f"{at}/classifier")
            else:
                classifier = Classifier.load(f"{at}/classifier")
            self._loaded = version, forest, classifier
        return self._loaded

    def models(self, batch_id: int) -> tuple[Forest | None, Classifier | BaggedForest | None, str]:
        """The newest models and their version, for :func:`rillwatch.streaming.jobs.scoring_handler`."""
        known = self.versions()
        if not known:
            raise ModelError(f"no models published in {self.path}")
        version, forest, classifier = self.load(known[-1])
        return forest, classifier, f"v{version}"
