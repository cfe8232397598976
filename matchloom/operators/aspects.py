"""What a module's curriculum needs beyond its lead: eleven aspects, each a vector, set against modules and leads."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The aspects and the terms that stand for them.
ASPECTS = {
    "ethics_governance_law": "artificial intelligence ethics ethical implications AI regulation algorithmic governance law intellectual property legal compliance data privacy accountability policy jurisprudence human rights",
    "economic_policy_finance_trade": "economics macroeconomics microeconomics economic policy fiscal policy monetary policy global trade international economics financial systems banking development economics econometrics public policy international finance",
    "behavioural_decision_making_economics": "behavioural economics consumer behaviour decision making game theory experimental economics market psychology cognitive biases bounded rationality economic experiments social preferences psychology of choice",
    "visual_perception_design_hci": "visual perception graphic design human computer interaction HCI user experience UX user interface UI data visualisation visual storytelling infographics dashboard aesthetics typography visual communication",
    "computational_modelling_numerical_sim": "computational modeling numerical methods scientific computing algorithms mathematical simulation Python programming differential equations applied mathematics computational science mathematical analysis",
    "robotics_hardware_embedded": "robotics autonomous systems hardware mechatronics embedded systems sensor networks microcontrollers IoT internet of things physical control aerospace mechanical automation actuators",
    "business_analytics_strategy": "business analytics strategy enterprise management technology adoption commercialisation executive decision making economics finance marketing digital transformation business model innovation",
    "healthcare_biomedical_applications": "healthcare clinical applications health informatics biomedical engineering medicine public health epidemiology medical imaging genetics patient diagnostics pharmacology healthcare analytics",
    "environmental_sustainability_climate": "environmental sustainability clean technology renewable energy climate change carbon footprint ecological modeling green computing circular economy environmental protection sustainable engineering",
    "cybersecurity_trust_cryptography": "cybersecurity cryptography digital trust security vulnerabilities network security threat modeling privacy encryption security audit cyber defense secure architecture",
    "behavioural_psychology_cognition": "cognitive psychology behavioural science human decision making cognition user perception neuroscience cognitive ergonomics psychometrics social psychology human factors",
}
#: Aspects of a catalogue at most; more is an error. All tasks hold their vectors.
MOST = 1_000


def encoded(encoder, aspects: dict[str, str] | None = None) -> dict[str, np.ndarray]:
    """Unit vectors of the aspects' terms. encoder: a list of texts -> vectors, as operators.semantic takes."""
    aspects = ASPECTS if aspects is None else aspects
    return dict(zip(aspects, np.asarray(encoder.encode(list(aspects.values())), float)))


def catalogue(aspects: DataFrame, name: str = "aspect", vector: str = "vector") -> dict[str, np.ndarray]:
    """The aspects of a table, whose number is bounded."""
    rows = aspects.select(F.col(name).cast("string").alias("n"), F.col(vector).alias("v")).limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} aspects")
    return {r["n"]: np.asarray(r["v"], float) for r in sorted(rows, key=lambda r: r["n"])}


def _unit(m: np.ndarray) -> np.ndarray:
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)


def _dense(column: pa.Array, dim: int) -> np.ndarray:
    """A row each; a vector that is null, holds null or has another length is zero."""
    out = np.zeros((len(column), dim))
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(size == dim)
    if len(at):
        flat = column.take(pa.array(at)).flatten().cast(pa.float64())
        rows = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)
        out[at] = np.where(np.isnan(rows).any(1, keepdims=True), 0.0, rows)
    return out


def affinities(modules: DataFrame, vectors: dict[str, np.ndarray], key: str = "module_id", vector: str = "vector", lead: str = "lead_vector") -> DataFrame:
    """key, aspect, affinity, lead of each module and aspect: cosines of the module's vector and of its lead's, 0 where there is none.

    One matrix product a batch where rows are read; nothing is exchanged.
    """
    names, matrix = list(vectors), _unit(np.stack([np.asarray(v, float) for v in vectors.values()])) if vectors else np.zeros((0, 1))
    kind = dict(modules.dtypes)[key]

    def run(batches):
        for b in batches:
            own, theirs = (_unit(_dense(b.column(i), matrix.shape[1])) @ matrix.T for i in (1, 2))
            n = len(names)
            ids = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), n)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(names * b.num_rows, pa.string()), pa.array(own.ravel(), pa.float64()), pa.array(theirs.ravel(), pa.float64())], names=[key, "aspect", "affinity", "lead"])

    return modules.select(key, vector, lead).mapInArrow(run, f"`{key}` {kind}, aspect string, affinity double, lead double")
