"""The research run as a whole: walk-forward folds as jobs of their own, written as they end, and the report over their test dates.

A run has a digest of its settings, its features and its panel, and a folder under it. A fold writes its models, its scored test rows and, last of
all, its audit; a fold whose audit is there isn't fitted again. So a run that was stopped goes on with the folds that lack, folds can be fitted by
different drivers, and another setting or another panel never meets their rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import Contract, ResearchConfig
from . import research as K
from .boosting import ListwiseModel, ListwiseSettings, fit_listwise
from .evaluation import daily_scores, summarize
from .panel import require_finite, require_unique
from .ranking import blend, risk_adjusted, top_n

INCUMBENT, LINEAR, BOOSTED = K.INCUMBENT, "linear-v1", "boosted-v1"
RESULT = ["ticker", "decision_date", "result_date", "universe_size", "forward_return", "is_explosion", "is_severe_downside", "is_catastrophic_loss", "rank_v6_score", "spy_return_20d"]


def panel_digest(panel: DataFrame) -> str:
    """Of the rows in whatever order: their number and two sums of hashes."""
    own = F.to_json(F.struct(*sorted(panel.columns)))
    total = [F.coalesce(F.sum(F.xxhash64(own, F.lit(k)).cast("decimal(38,0)")), F.lit(0)).cast("string") for k in (1, 2)]
    return panel.agg(F.sha2(F.concat_ws("|", F.count("*"), *total), 256).alias("d")).first().d


@dataclass
class Run:
    """A panel with its date quality, the settings, and the folder ``place``/digest that its folds are written to.

    panel: keys, outcomes and labels, rank_v6_score, rank_v6, spy_return_20d and the features. extra: features from external data, which make
    the run exploratory."""

    spark: SparkSession
    panel: DataFrame
    quality: DataFrame
    place: str
    features: Sequence[str] = K.RANKS
    linear_features: Sequence[str] | None = None
    config: ResearchConfig = ResearchConfig()
    contract: Contract = Contract()
    listwise: ListwiseSettings = ListwiseSettings()
    risk_rounds: int = 200
    extra: Sequence[str] = ()

    def __post_init__(self):
        self.features, self.linear = [*self.features, *self.extra], list(self.linear_features or self.features)
        if len(set(self.features)) < len(self.features):
            raise ValueError("feature names repeat")
        lacking = {*RESULT, "rank_v6", "date_valid", "ranking_relevance", *self.features, *self.linear} - set(self.panel.columns)
        if lacking:
            raise ValueError(f"the panel lacks {sorted(lacking)}")
        require_unique(self.panel, ["ticker", "decision_date"], "the panel")
        require_finite(self.panel.filter("date_valid"), self.features)
        self.snapshot = panel_digest(self.panel)
        told = {"config": asdict(self.config), "contract": asdict(self.contract), "listwise": asdict(self.listwise), "risk_rounds": self.risk_rounds, "features": self.features, "linear": self.linear, "panel": self.snapshot}
        self.digest = hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()
        self.root = f"{self.place}/{self.digest}"
        self.rows = self._kept(K.folds(self.quality, self.config), "folds")
        self.audit = K.fold_audit(self.rows, self.config)
        bad = self.audit.filter("NOT clean")
        if self.audit.isEmpty():
            raise ValueError("there are too few valid dates for a fold")
        if not bad.isEmpty():
            raise ValueError("a fold is too small or leaks outcomes")

    def _there(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _kept(self, rows: DataFrame, name: str) -> DataFrame:
        """A table of the run, written once."""
        path = f"{self.root}/{name}"
        if not self._there(path):
            rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _cut(self, fold: int):
        n = iter(range(1_000_000))

        def cut(rows: DataFrame) -> DataFrame:
            path = f"{self.root}/work/fold={fold}/{next(n) % 2}-{next(n)}"
            rows.write.mode("overwrite").parquet(path)
            return self.spark.read.schema(rows.schema).parquet(path)

        return cut

    def folds(self) -> list[int]:
        return sorted(r.fold for r in self.audit.select("fold").collect())

    def done(self, fold: int) -> bool:
        return self._there(f"{self.root}/audits/fold={fold}")

    def fit(self, fold: int) -> None:
        """One fold: its models see its training and validation dates alone; validation chooses the blend's weight and the risk's strength."""
        if self.done(fold):
            return
        training, validation, test = (K.rows_of(self.panel, self.rows, fold, r) for r in ("training", "validation", "test"))
        if test.isEmpty():
            raise ValueError(f"fold {fold} has no test rows")
        c, contract, where = self.config, self.contract, f"{self.root}/models/fold={fold}"
        ridge = K.RidgeRanker(self.linear, c.l2).fit(training)
        boom = self._model(f"{where}/boom", lambda: fit_listwise(training, validation, self.features, self.listwise, self._cut(fold)))
        seen = boom.predict(validation, "boom")
        choice = K.choose_blend(seen, "rank_v6_score", "boom", c, contract).filter("chosen").first()
        weighed = lambda f: blend(f, "rank_v6_score", "boom", choice.weight)
        # The risk model learns on the incumbent's leaders and stops on those of the blend.
        leaders = lambda f, score: top_n(f, score, contract.inspect).select("ticker", "decision_date", "is_severe_downside", *self.features)
        risk = K.fit_risk(leaders(training, "rank_v6_score"), leaders(weighed(seen), "blend"), self.features, self.risk_rounds, c.seed)
        risky = lambda f: K.predict(risk, f, self.features, "risk", True)
        strength = K.choose_lambda(risky(weighed(seen)), "blend", "risk", c, contract).filter("chosen").first()
        risk.write().overwrite().save(f"{where}/risk")
        out = risk_adjusted(risky(weighed(boom.predict(test, "boom"))), "blend", "risk", strength.risk_lambda, contract.inspect, name="boosted_score")
        out.select(*RESULT, ridge.expression().alias("linear_score"), "boom", "risk", "boosted_score").write.mode("overwrite").parquet(f"{self.root}/scored/fold={fold}")
        counts = {"training_rows": training.count(), "validation_rows": validation.count(), "test_rows": test.count()}
        told = counts | {
            "rounds": len(boom.trees), "risk_trees": risk.getNumTrees, "blend_weight": float(choice.weight), "blend_precision_at_10": choice.precision_at_10, "blend_downside_at_10": choice.downside_at_10,
            "risk_lambda": float(strength.risk_lambda), "validation_precision_at_10": strength.precision_at_10, "validation_downside_at_10": strength.downside_at_10,
        }
        self.spark.createDataFrame([told]).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/audits/fold={fold}")

    def _model(self, path: str, fit) -> ListwiseModel:
        """A model that was written before the run was stopped is read back."""
        if not self._there(path):
            state = json.dumps(fit().state())
            self.spark.createDataFrame([(state,)], "state string").coalesce(1).write.mode("overwrite").parquet(path)
        return ListwiseModel.of(json.loads(self.spark.read.parquet(path).first().state))

    def fit_all(self) -> list[int]:
        """Folds that had to be fitted."""
        new = [f for f in self.folds() if not self.done(f)]
        for f in new:
            self.fit(f)
        return new

    def scored(self) -> DataFrame:
        """Test rows of all folds, which must all be there."""
        lacking = [f for f in self.folds() if not self.done(f)]
        if lacking:
            raise ValueError(f"folds {lacking} aren't fitted")
        return self.spark.read.option("basePath", f"{self.root}/scored").parquet(*[f"{self.root}/scored/fold={f}" for f in self.folds()])

    def report(self) -> dict[str, DataFrame]:
        """daily, summary, stability, bootstrap, tail_bootstrap, recent, promotion, folds (audit and choices), run (digests)."""
        scored, c, contract = self.scored(), self.config, self.contract
        parts = [scored.withColumn("strategy", F.lit(s)).withColumn("s", F.col(column)) for s, column in ((INCUMBENT, "rank_v6_score"), (LINEAR, "linear_score"), (BOOSTED, "boosted_score"))]
        daily = self._kept(daily_scores(parts[0].unionByName(parts[1]).unionByName(parts[2]), "s", contract), "daily")
        summary = summarize(daily, contract)
        pairs = self._kept(K.paired(daily, BOOSTED), "pairs")
        interval, recent, segments = K.bootstrap(pairs, c, contract), K.recent_uplift(pairs), K.stability(pairs, self.rows, contract)
        told = self.spark.read.option("basePath", f"{self.root}/audits").parquet(f"{self.root}/audits")
        run = self.spark.createDataFrame([(self.digest, self.snapshot, bool(self.extra))], "config_digest string, panel_digest string, exploratory boolean")
        return {
            "daily": daily, "summary": summary, "stability": segments, "bootstrap": interval, "tail_bootstrap": K.tail_bootstrap(pairs, c, contract), "recent": recent,
            "promotion": K.promotion(summary, interval, recent, segments, BOOSTED, c.locked_test_dates, c, bool(self.extra)), "folds": self.audit.join(F.broadcast(told), "fold"), "run": run,
        }
