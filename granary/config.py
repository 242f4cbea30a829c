"""Every threshold of the engine in one place."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class AuditConfig:
    """Limits of the audit: modified z-scores on log values, materiality, and samples a baseline needs."""

    z_threshold: float = 3.5
    mad_constant: float = 0.6745
    min_samples: int = 30
    quantity_min_fold: float = 3.0
    price_min_relative: float = 0.30
    order_min_fold: float = 3.0
    min_customer_stock_lines: int = 5
    min_customer_lines: int = 20
    min_customer_invoices: int = 5
    return_window_days: int = 30
    severity_high: float = 1000.0
    severity_medium: float = 100.0
    currency: str = "GBP"
    reference_mode: str = "in_sample"


@dataclass(frozen=True)
class CleanConfig:
    """Lines that are charges rather than goods."""

    # fixed values
    service_codes: tuple[str, ...] = ("POST", "M", "DOT", "BANK CHARGES", "C2", "PADS")
    service_descriptions: tuple[str, ...] = ("PACKING CHARGE", "NEXT DAY CARRIAGE")


@dataclass(frozen=True)
class RfmConfig:
    """Cuts of the percent rank and what counts as inactive."""

    cuts: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8)
    churn_days: int = 90
    high_value_score: int = 4
    rule_version: str = "rfm-rule-v1"


@dataclass(frozen=True)
class Config:
    audit: AuditConfig = field(default_factory=AuditConfig)
    clean: CleanConfig = field(default_factory=CleanConfig)
    rfm: RfmConfig = field(default_factory=RfmConfig)


DEFAULT = Config()
