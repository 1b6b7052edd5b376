"""Settings of the engine, each overridable by an environment variable ``FOLIO_<NAME>``."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from decimal import Decimal


@dataclass(frozen=True)
class Config:
    text_model: str = "mistral:latest"
    escalation_model: str = ""
    vision_model: str = "qwen2.5vl:7b"
    timeout_s: int = 1800
    temperature: float = 0.0
    context_tokens: int = 8192
    render_dpi: int = 300
    max_pixels: int = 1600
    scanned_char_threshold: int = 20
    max_chars_over_region: int = 3
    region_min_area: float = 0.04
    region_min_width: float = 0.5
    region_max_area: float = 0.6
    full_page_image: float = 0.85
    attempts_per_field: int = 2
    max_rounds: int = 3
    tier_rounds: int = 2
    totals_tolerance: Decimal = Decimal("0.01")
    line_sum_tolerance: Decimal = Decimal("0.05")
    confident_hint: int = 2
    stable_fields: tuple[str, ...] = field(default=("seller_name", "seller_address", "seller_rc_number", "seller_capital"))

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Config:
        env = dict(os.environ) if env is None else env
        given = {}
        for f in fields(cls):
            raw = env.get(f"FOLIO_{f.name.upper()}")
            if raw is not None:
                kind = type(getattr(cls(), f.name))
                given[f.name] = tuple(raw.split(",")) if kind is tuple else kind(raw)
        return cls(**given)


DEFAULT = Config()
#: Amounts inside e-invoices are compared as floating-point numbers within this tolerance.
XML_TOLERANCE = 0.02
