"""Thresholds and limits; one frozen value is passed to every operator that needs any."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    classification_threshold: float = 0.70
    rounding_tolerance: str = "0.05"
    vision_threshold: float = 0.70
    crop_padding: int = 25
    max_key_points: int = 5
    max_review_items: int = 5
    max_actions: int = 10
    max_upload_bytes: int = 10 * 1024 * 1024
    max_image_side: int = 2400
    due_soon_days: int = 7
    classify_chars: int = 7500
    section_chars: int = 10000
    context_fields: int = 25
    as_of: datetime.date = field(default_factory=datetime.date.today)
    #: True: keep the historical quirks of section-blind conflicts, unmasked id numbers and re-validation of vision outcomes.
    legacy: bool = False


DEFAULT = Settings()
