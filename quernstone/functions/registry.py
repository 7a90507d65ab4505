"""The coding methods by id: their names, and the stages that a stream goes through."""

from __future__ import annotations

#: The names of the methods in the order of their ids, from 0.
NAMES = [
    "rawcm", "rawcm-noword", "struct-hoist", "alphabet-perm", "alphabet-random", "info-inherit", "info-unrelated", "alphabet-perm+info-inherit", "column", "column-shuffled", "column-noline", "case", "case-mark", "column-case",
    "column-case-mark", "word-token", "word-token-reverse", "column-word-token", "column-word-token-reverse", "word-token2", "column-word-token2", "long-match6", "long-match8", "long-match12", "long-match16", "long-match24",
    "sparse-match4g1", "sparse-match6g1", "sparse-match6g2", "rep-state1", "rep-state2", "rep-state3", "rep-state4", "match-byte", "match-byte-const", "phase4", "dist-match", "stem", "word-class", "word-class-const",
    "column-word-token-phrase", "column-word-token-phrase-freq", "column-word-token-front", "column-word-token-affix", "grammar", "grammar-mtf", "grammar-mr", "grammar-rrank", "grammar-first-use", "grammar-oneshot", "lzbe",
    "state-map", "state-map-ctl", "state-map-rep", "sse-3", "sse-3-ctl", "sparse4g1", "sparse4g1-ctl", "sparse4g1-rep", "icm", "icm-ctl", "indirect-chain", "indirect-deep", "collision", "collision-ctl", "ppm", "ppm-ctl",
    "stem-model", "stem-model-ctl", "isse", "isse-ctl", "phase6", "spine", "reorder-id", "reorder-title", "reorder-size", "reorder-struct", "reorder-minhash", "reorder-greedy", "reorder-template", "reorder-shuffle",
    "reorder-category", "reorder-template-key", "reorder-category-set", "reorder-full", "reorder-full-residual", "residual", "residual-ctl", "residual-mtf", "residual-move-to-second", "residual-priced",
    "residual-price-filter", "residual-affix", "residual-first-use", "residual-subword",
]
#: The page order of the methods 73 to 85; later ones use the full order.
ORDERS = ["identity", "title", "size", "namespace", "minhash", "greedy", "boilerplate", "shuffle", "category", "template", "category_set", "full", "full_novelty"]

_TOKENS = {
    15: "token", 16: "token_reverse", 17: "token", 18: "token_reverse", 19: "token_wide", 20: "token_wide", 40: "token_phrase_reverse", 41: "token_phrase", 42: "token_front_coded", 43: "token_affix",
    88: "token_front", 89: "token_second", 90: "token_repriced", 91: "token_paying", 92: "token_affix", 93: "token_first_use", 94: "token_subword",
}
_GRAMMARS = ["grammar", "grammar_mtf", "grammar_repeats", "grammar_ranked", "grammar_inline", "grammar_once"]


def page_order(i: int) -> str | None:
    return "full" if i >= 86 else ORDERS[i - 73] if i >= 73 else None


def stages(i: int) -> list[str]:
    """The transforms of a method in the order of encoding, after the page order."""
    fourth = i == 35 or i >= 51
    out = ["factor"] if i == 50 else [_GRAMMARS[i - 44]] if 44 <= i <= 49 else ["stem"] if i == 37 else []
    if fourth or 2 <= i <= 10 or i in (13, 14, 17, 18) or 20 <= i <= 36 or 38 <= i <= 43:
        out.append("hoist")
    if i in (11, 13):
        out.append("case")
    if i in (12, 14):
        out.append("case_mark")
    if i in _TOKENS:
        out.append(_TOKENS[i])
    elif fourth or 21 <= i <= 36 or i in (38, 39):
        out.append("token_reverse")
    if i in (3, 7):
        out.append("permute")
    if i == 4:
        out.append("permute_random")
    return out
