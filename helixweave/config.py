"""Settings by name, and numbers as people read them."""

from __future__ import annotations

import logging
from dataclasses import dataclass, replace

from helixweave.functions import signal
from helixweave.operators import seeds
from helixweave.operators import signal as sig

log = logging.getLogger(__name__)

#: What turns normalised values into tokens, and tokens into seeds, by name; the first names stand for what isn't known.
TOKENIZERS = {"rh2": signal.adaptive_token, "rawhash2": signal.adaptive_token, "": signal.adaptive_token, "landmark": sig.valleys}
EXTRACTORS = {"kmer": seeds.token_kmers, "minimizer": seeds.minimizers}


def tokenizer(name: str):
    if name.lower() not in TOKENIZERS:
        log.warning("unknown tokenizer %s: rh2 takes its place", name)
    return TOKENIZERS.get(name.lower(), signal.adaptive_token)


def extractor(name: str):
    return EXTRACTORS.get(name.lower(), seeds.token_kmers)


@dataclass(frozen=True)
class Decisions:
    min_anchors: int = 5
    ratio_low: float = 0.0
    ratio_high: float = float("inf")
    threshold: float = 0.45
    floor: float = 100.0


def preset(name: str, **own) -> Decisions:
    """Fixed values of the presets small and large; own settings last."""
    base = Decisions(min_anchors=2, ratio_low=0.5, ratio_high=1.7) if name in ("small", "large") else Decisions()
    return replace(base, **{k: v for k, v in own.items() if v is not None})


def scaled(n: float, step: int, units: tuple[str, ...], digits: int = 1) -> str:
    k = 0
    while abs(n) >= step and k < len(units) - 1:
        n, k = n / step, k + 1
    return f"{n:.{digits if k else 0}f}{units[k]}"


def as_bytes(n: float) -> str:
    return scaled(n, 1024, (" B", " KB", " MB", " GB", " TB"))


def as_count(n: float) -> str:
    return scaled(n, 1000, ("", "K", "M", "G"))


def as_duration(seconds: float) -> str:
    if seconds < 60:
        return f"{seconds:.1f}s"
    minutes, seconds = divmod(int(round(seconds)), 60)
    hours, minutes = divmod(minutes, 60)
    return f"{hours}h {minutes}m {seconds}s" if hours else f"{minutes}m {seconds}s"
