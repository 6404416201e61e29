"""Scoring settings: typed defaults, validation and the canonical key stored with every result."""

from __future__ import annotations

import json
import math
import re
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX64 = re.compile(r"^[0-9a-fA-F]{64}$")

# A change of any of these requires new feature extraction.
DETECTION_KEYS = (
    "face_confidence",
    "execution_provider",
    "directml_device_id",
    "max_faces",
    "enable_niqe",
    "face_detector",
    "scrfd_model_sha256",
    "occlusion_provider",
    "occlusion_model_sha256",
    "occlusion_min_visible_fraction",
)
SEMANTIC_KEYS = ("embedding_provider", "embedding_model_sha256", "semantic_similarity_threshold")
WEIGHT_KEYS = ("eyes_weight", "sharpness_weight", "face_weight", "exposure_weight", "smile_weight")


@dataclass(frozen=True)
class Settings:
    execution_provider: str = "cpu"
    directml_device_id: int | None = None
    eyes_weight: float = 25.0
    sharpness_weight: float = 25.0
    face_weight: float = 20.0
    exposure_weight: float = 20.0
    smile_weight: float = 10.0
    face_confidence: float = 0.55
    max_faces: int = 10
    recommend_threshold: float = 70.0
    reject_threshold: float = 25.0
    enable_niqe: bool = True
    niqe_weight: float = 0.2
    face_detector: str = "yunet"
    scrfd_model_sha256: str | None = None
    occlusion_provider: str = "none"
    occlusion_model_sha256: str | None = None
    occlusion_min_visible_fraction: float | None = None
    embedding_provider: str = "none"
    embedding_model_sha256: str | None = None
    semantic_similarity_threshold: float | None = None

    def __post_init__(self) -> None:
        weights = [getattr(self, k) for k in WEIGHT_KEYS]
        if any(not math.isfinite(w) or not 0 <= w <= 100 for w in weights) or sum(weights) <= 0:
            raise ValueError("weights must be finite 0..100 with a positive total")
        if not 0.1 <= self.face_confidence <= 0.99 or not 1 <= self.max_faces <= 10:
            raise ValueError("invalid face confidence or face limit")
        if not 0 <= self.niqe_weight <= 1:
            raise ValueError("niqe_weight must be a fraction")
        if not 0 <= self.reject_threshold < self.recommend_threshold <= 100:
            raise ValueError("thresholds must satisfy 0 <= reject < recommend <= 100")
        for name in ("scrfd_model_sha256", "occlusion_model_sha256", "embedding_model_sha256"):
            value = getattr(self, name)
            if value is not None and not _HEX64.match(value):
                raise ValueError(f"{name} must be 64 hexadecimal characters")
        for name in ("occlusion_min_visible_fraction", "semantic_similarity_threshold"):
            value = getattr(self, name)
            if value is not None and not (math.isfinite(value) and 0 < value <= 1):
                raise ValueError(f"{name} must be in (0, 1]")
        if self.embedding_provider != "none" and None in (
            self.embedding_model_sha256,
            self.semantic_similarity_threshold,
        ):
            raise ValueError("an embedding provider needs a model digest and a threshold")
        if self.occlusion_provider != "none" and None in (
            self.occlusion_model_sha256,
            self.occlusion_min_visible_fraction,
        ):
            raise ValueError("an occlusion provider needs a model digest and a minimum fraction")
        if self.face_detector == "scrfd_500m" and self.scrfd_model_sha256 is None:
            raise ValueError("this detector needs a model digest")

    @classmethod
    def parse(cls, value: dict | str) -> "Settings":
        data = json.loads(value) if isinstance(value, str) else dict(value)
        unknown = set(data) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**data)

    def canonical(self) -> str:
        """Stable text with defaults filled; equal settings give equal text."""
        return json.dumps(asdict(self), sort_keys=True, separators=(",", ":"))

    def changed_keys(self, other: "Settings") -> list[str]:
        return sorted(f.name for f in fields(self) if getattr(self, f.name) != getattr(other, f.name))


def scoring_settings_key(json_text: Column) -> Column:
    """Canonical key of stored settings text as a column; NULL when invalid.

    Missing keys take their defaults, so old and new records with the same
    meaning get the same key. Unknown keys and out-of-range values give NULL.
    """
    d = Settings()
    numeric = [*WEIGHT_KEYS, "face_confidence", "recommend_threshold", "reject_threshold", "niqe_weight"]
    kinds = {n: "double" for n in numeric} | {"max_faces": "int", "enable_niqe": "boolean"}
    kinds |= {
        f.name: "double" if f.name in ("occlusion_min_visible_fraction", "semantic_similarity_threshold") else "int" if f.name == "directml_device_id" else "string"
        for f in fields(Settings)
        if f.name not in kinds
    }
    variant = F.try_parse_json(json_text)
    keys = F.json_object_keys(json_text)
    known = F.array(*[F.lit(k) for k in sorted(kinds)])
    # A stored value of the wrong type must reject the record, not become a default.
    text = {k: F.get_json_object(json_text, f"$.{k}") for k in kinds}
    typed = {k: F.try_variant_get(variant, f"$.{k}", t) for k, t in kinds.items()}
    default = {k: F.lit(getattr(d, k)).cast(t) for k, t in kinds.items()}
    value = {k: F.coalesce(typed[k], default[k]) for k in kinds}
    ok = variant.isNotNull() & (F.size(F.array_except(keys, known)) == 0)
    for k in kinds:
        ok = ok & (text[k].isNull() | typed[k].isNotNull())
    weights = [value[k] for k in WEIGHT_KEYS]
    total = weights[0]
    for w in weights[1:]:
        total = total + w
    for w in weights:
        ok = ok & w.between(0.0, 100.0)
    ok = ok & (total > 0) & value["face_confidence"].between(0.1, 0.99)
    ok = ok & value["max_faces"].between(1, 10) & value["niqe_weight"].between(0.0, 1.0)
    ok = ok & (value["reject_threshold"] >= 0) & (value["recommend_threshold"] <= 100)
    ok = ok & (value["reject_threshold"] < value["recommend_threshold"])
    for k in ("scrfd_model_sha256", "occlusion_model_sha256", "embedding_model_sha256"):
        ok = ok & (value[k].isNull() | value[k].rlike("^[0-9a-fA-F]{64}$"))
    for k in ("occlusion_min_visible_fraction", "semantic_similarity_threshold"):
        ok = ok & (value[k].isNull() | ((value[k] > 0) & (value[k] <= 1)))
    ok = ok & ((value["embedding_provider"] == "none") | (value["embedding_model_sha256"].isNotNull() & value["semantic_similarity_threshold"].isNotNull()))
    ok = ok & ((value["occlusion_provider"] == "none") | (value["occlusion_model_sha256"].isNotNull() & value["occlusion_min_visible_fraction"].isNotNull()))
    ok = ok & ((value["face_detector"] != "scrfd_500m") | value["scrfd_model_sha256"].isNotNull())
    body = F.to_json(F.struct(*[value[k].alias(k) for k in sorted(kinds)]), {"ignoreNullFields": "false"})
    return F.when(F.coalesce(ok, F.lit(False)), F.sha2(body, 256))
