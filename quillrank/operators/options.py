"""Names, ranges and combinations of the options that an index takes beside its scoring parameters and text policy."""

from __future__ import annotations

SEMANTIC = ("runtime_precision", "semantic_impact_precision", "semantic_alpha_mass", "model", "model_path", "atom_space", "scoring_profile")
KNOWN = ("auto_preload", "sae", *SEMANTIC)
PRECISIONS = ("f32", "fp16", "u8")


def check_options(options: dict, *, consistency: str, params=None, policy=None) -> None:
    """Unknown names, values out of range, and combinations that exclude each other are errors."""
    unknown = sorted(set(options) - set(KNOWN))
    if unknown:
        raise ValueError(f"no option {unknown[0]!r}")
    for name in ("auto_preload", "sae"):
        if not isinstance(options.get(name, False), bool):
            raise ValueError(f"{name} is true or false")
    for name in ("runtime_precision", "semantic_impact_precision"):
        if options.get(name, "f32") not in PRECISIONS:
            raise ValueError(f"{name} is one of {PRECISIONS}")
    if not 0.01 <= float(options.get("semantic_alpha_mass", 1.0)) <= 1:
        raise ValueError("semantic_alpha_mass is from 0.01 to 1")
    semantic = bool(options.get("sae", False))
    given = [x for x in SEMANTIC if x in options]
    if given and not semantic:
        raise ValueError(f"{given[0]} needs sae")
    if semantic and consistency != "eventual":
        raise ValueError("sae needs eventual consistency")
    if semantic and (params is not None or policy is not None):
        raise ValueError("sae takes neither scoring nor text options")
