"""The twenty conversion pipelines as rounds of dictionary slots.

A round lists slots in order of precedence; round 2 reads what round 1 wrote. `+p` slots join when punctuation is
asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

_S2T, _S2T_P = ("st_phrases", "st_characters"), ("st_punctuations",)
_T2S, _T2S_P = ("ts_phrases", "ts_characters"), ("ts_punctuations",)
_TW, _TWP = ("tw_variants_phrases", "tw_variants"), ("tw_phrases", "tw_variants_phrases", "tw_variants")
_TW_REV, _TWP_REV = ("tw_variants_rev_phrases", "tw_variants_rev"), ("tw_phrases_rev", "tw_variants_rev_phrases", "tw_variants_rev")
_HK, _HKP = ("hk_variants_phrases", "hk_variants"), ("hk_phrases", "hk_variants_phrases", "hk_variants")
_HK_REV, _HKP_REV = ("hk_variants_rev_phrases", "hk_variants_rev"), ("hk_phrases_rev", "hk_variants_rev_phrases", "hk_variants_rev")


@dataclass(frozen=True)
class Config:
    name: str
    rounds: tuple[tuple[str, ...], ...]
    #: Round that punctuation joins, and its slots; a round number beyond the last adds one.
    punct: tuple[int, tuple[str, ...]]

    def plan(self, punctuation: bool = False) -> list[tuple[str, ...]]:
        out = [list(r) for r in self.rounds]
        if punctuation:
            at, slots = self.punct
            if at == len(out):
                out.append([])
            out[at] += slots
        return [tuple(r) for r in out]


def _all() -> dict[str, Config]:
    first = lambda r2=None: ((_S2T,) if r2 is None else (_S2T, r2), (0, _S2T_P))
    last = lambda r1=None: ((_T2S,), (0, _T2S_P)) if r1 is None else ((r1, _T2S), (1, _T2S_P))
    same = lambda r1: ((r1,), (1, _S2T_P))
    table = {
        "s2t": first(),
        "s2tw": first(_TW),
        "s2twp": first(_TWP),
        "s2hk": first(_HK),
        "s2hkp": first(_HKP),
        "t2s": last(),
        "t2tw": same(_TW),
        "t2twp": same(_TWP),
        "t2hk": same(_HK),
        "t2hkp": same(_HKP),
        "tw2s": last(_TW_REV),
        "tw2sp": last(_TWP_REV),
        "tw2t": same(_TW_REV),
        "tw2tp": same(_TWP_REV),
        "hk2s": last(_HK_REV),
        "hk2sp": last(_HKP_REV),
        "hk2t": same(_HK_REV),
        "hk2tp": same(_HKP_REV),
        "t2jp": same(("jps_characters_rev",)),
        "jp2t": same(("jps_phrases", "jps_characters")),
    }
    return {k: Config(k, *v) for k, v in table.items()}


CONFIGS = _all()
DEFAULT = "s2t"


def supported_configs() -> list[str]:
    return list(CONFIGS)


def is_valid_config(name: str | None) -> bool:
    return (name or "").strip().lower() in CONFIGS


def parse_config(name: str | None, on_invalid: str = "raise") -> Config:
    """on_invalid `default` falls back to s2t instead of raising."""
    key = (name or "").strip().lower()
    if key in CONFIGS:
        return CONFIGS[key]
    if on_invalid == "default":
        return CONFIGS[DEFAULT]
    raise ValueError(f"invalid config: {name!r}")
