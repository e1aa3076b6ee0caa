"""What an evaluation has to cover, and whether a plan does."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

# Names of what is asked, compared and measured (fixed values).
QUESTIONS = ("Resolution", "Calibration", "Revision", "Locality", "Scale", "Recovery", "ProviderAgnosticism", "Interoperability")
BASELINES = ("IndependentPairwise", "FellegiSunter", "BayesianGraphical", "IncrementalLinkage", "Tracking", "WithoutCollectiveFactors", "OracleCandidates")
RESOLUTION_METRICS = ("PairwisePrecision", "PairwiseRecall", "PairwiseF1", "BCubed", "AdjustedRand", "FalseMergeRate", "FalseSplitRate", "NewIdentityPrecision")
CALIBRATION_METRICS = ("NegativeLogLikelihood", "Brier", "ExpectedCalibrationError", "ReliabilityDiagram", "RiskCoverage")
SYSTEM_METRICS = ("Throughput", "MedianLatency", "P95Latency", "P99Latency", "PeakResidentMemory", "AllocatedBytesPerObservation", "QueueDepth", "CheckpointPause", "RecoveryTime", "WriteAmplification", "StorageGrowth")


@dataclass(frozen=True)
class Synthetic:
    identities: int = 1_000
    motion_noise: float = 1.0
    sensor_noise: float = 1.0
    missing_rate: float = 0.1
    correlated_rate: float = 0.1
    clutter_rate: float = 0.1
    variable_arrival: bool = True
    reappearance: bool = True
    merges_and_splits: bool = True

    def complete(self) -> bool:
        rates = (self.missing_rate, self.correlated_rate, self.clutter_rate)
        noise = (self.motion_noise, self.sensor_noise)
        numbers = all(math.isfinite(r) and 0 <= r <= 1 for r in rates) and all(math.isfinite(x) and x >= 0 for x in noise)
        return self.identities > 0 and numbers and self.variable_arrival and self.reappearance and self.merges_and_splits


@dataclass(frozen=True)
class RealData:
    timestamps: bool = True
    repeated_observations: bool = True
    modalities: int = 2
    relations: int = 0

    def usable(self) -> bool:
        return self.timestamps and self.repeated_observations and max(self.modalities, self.relations) >= 2


@dataclass(frozen=True)
class Plan:
    """The default plan is complete."""

    questions: frozenset = frozenset(QUESTIONS)
    synthetic: Synthetic = field(default_factory=Synthetic)
    real: RealData = field(default_factory=RealData)
    baselines: frozenset = frozenset(BASELINES)
    metrics: frozenset = frozenset(RESOLUTION_METRICS + CALIBRATION_METRICS + SYSTEM_METRICS)
    blinded: bool = True
    ablations: frozenset = frozenset(("provider", "boundary", "architecture"))
    faults: frozenset = frozenset(("ledger", "host"))
    reproducible: bool = True

    def error(self) -> str | None:
        """The first gap, None if there is none."""
        gaps = (
            (not self.questions >= set(QUESTIONS), "MissingResearchQuestion"),
            (not self.synthetic.complete(), "IncompleteSyntheticControls"),
            (not self.real.usable(), "InvalidRealDataset"),
            (not self.blinded, "GroundTruthLeakage"),
            (not self.baselines >= set(BASELINES), "MissingBaseline"),
            (not self.metrics >= set(RESOLUTION_METRICS + CALIBRATION_METRICS + SYSTEM_METRICS), "MissingMetric"),
            (not self.ablations >= {"provider", "boundary", "architecture"}, "MissingAblation"),
            (not self.faults >= {"ledger", "host"}, "MissingFaultPoint"),
            (not self.reproducible, "MissingReproducibilityMetadata"),
        )
        return next((code for gap, code in gaps if gap), None)
