"""Column functions of the game: seats, vulnerability, hands, scores. All are built-in expressions, inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the game and of the data formats
SEATS, SUITS, STRAINS, TRICK_STRAINS = "NESW", "SHDC", "CDHSN", "SHDCN"
RANKS = "AKQJT98765432"
VULS = ["None", "N_S", "E_W", "Both"]
PARTNER = {"N": "S", "E": "W", "S": "N", "W": "E"}
NEXT = {"N": "E", "E": "S", "S": "W", "W": "N"}


def lookup(values: dict, key: Column) -> Column:
    """Map literal; unknown keys give null (strict callers check with check_known)."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out


def nth(text: str, index: Column) -> Column:
    """The character of a constant at a 0-based index."""
    return F.substring(F.lit(text), index.cast("int") + 1, F.lit(1))


def dealer_of(board: Column) -> Column:
    return nth(SEATS, F.pmod(board - 1, F.lit(4)))


def vul_code(board: Column) -> Column:
    """0 none, 1 NS, 2 EW, 3 both."""
    return (F.floor((board - 1) / 4) + F.pmod(board - 1, F.lit(4))).cast("int").bitwiseAND(F.lit(3))


def vul_name(code: Column) -> Column:
    return lookup(dict(enumerate(VULS)), code)


def side_of(seat: Column) -> Column:
    return F.when(seat.isin("N", "S"), "NS").when(seat.isin("E", "W"), "EW")


def seat_is_vulnerable(code: Column, seat: Column) -> Column:
    """Of a seat or a side, under a vulnerability code."""
    return F.when(seat.isin("N", "S", "NS"), code.bitwiseAND(F.lit(1)) > 0).when(seat.isin("E", "W", "EW"), code.bitwiseAND(F.lit(2)) > 0)


def hands(pbn: Column) -> Column:
    """array<array<string>>: suits (S, H, D, C) of the seats N, E, S, W of a text that starts with N."""
    return F.transform(F.split(F.substring(pbn, F.lit(3), F.length(pbn)), " ", -1), lambda h: F.split(h, "\\.", -1))


def count_of(cards: Column, rank: str) -> Column:
    return F.length(cards) - F.length(F.replace(cards, F.lit(rank), F.lit("")))


def suit_hcp(cards: Column) -> Column:
    return count_of(cards, "A") * 4 + count_of(cards, "K") * 3 + count_of(cards, "Q") * 2 + count_of(cards, "J")


def suit_quick_tricks(cards: Column) -> Column:
    starts = lambda p: F.startswith(cards, F.lit(p))
    return F.when(starts("AK"), 2.0).when(starts("AQ"), 1.5).when(starts("A"), 1.0).when(starts("KQ"), 1.0).when(starts("K"), 0.5).otherwise(0.0)


def suit_losers(cards: Column) -> Column:
    n, has = F.length(cards), lambda r: F.contains(cards, F.lit(r)).cast("int")
    two = F.when(F.startswith(cards, F.lit("AK")), 0).when(F.startswith(cards, F.lit("A")) | F.startswith(cards, F.lit("K")), 1).otherwise(2)
    return F.when(n == 0, 0).when(n == 1, 1 - has("A")).when(n == 2, two).otherwise(3 - has("A") - has("K") - has("Q"))


def suit_distribution(cards: Column) -> Column:
    return F.greatest(F.lit(0), 3 - F.length(cards))


def score_rule(level: int, strain: int, doubled: int, vulnerable: bool, tricks: int) -> int:
    """Duplicate score for the declaring side; strain by its place in STRAINS, doubled 0, 1 or 2 times."""
    over = tricks - 6 - level
    if over < 0:
        if not doubled:
            return over * (100 if vulnerable else 50)
        # the first undertrick, the second and third, all after them
        steps = [200] + [300] * 12 if vulnerable else [100, 200, 200] + [300] * 10
        return -doubled * sum(steps[:-over])
    per_trick = 20 if strain < 2 else 30
    trick_points = (per_trick * level + (10 if strain == 4 else 0)) << doubled
    bonus = 50 if trick_points < 100 else 500 if vulnerable else 300
    if level >= 6:
        bonus += (level - 5) * (750 if vulnerable else 500)
    each = doubled * (200 if vulnerable else 100) if doubled else per_trick
    return trick_points + bonus + 50 * doubled + over * each


#: every score there is, ordered by level, strain, doubling, vulnerability and tricks; made from the rule
_SCORES = ",".join(str(score_rule(level, strain, doubled, vul, t)) for level in range(1, 8) for strain in range(5) for doubled in range(3) for vul in (False, True) for t in range(14))

#: the best score of any level, ordered by strain, vulnerability and tricks, failing contracts doubled
_BEST = ",".join(str(max(score_rule(level, strain, int(t < level + 6), vul, t) for level in range(1, 8))) for strain in range(5) for vul in (False, True) for t in range(14))


def contract_score(level: Column, strain: Column, doubled: Column, vulnerable: Column, result: Column) -> Column:
    """Duplicate score of a contract for the declaring side; result is tricks over (or under, negative) the contract; doubled is '', X or XX.

    A constant array is looked up, so the expression stays small wherever it is used. Null for results that no trick count gives and unknown strains.
    """
    tricks = result + level + 6
    times = F.when(doubled == "XX", 2).when(doubled == "X", 1).otherwise(0)
    place = ((((level - 1) * 5 + F.instr(F.lit(STRAINS), strain) - 1) * 3 + times) * 2 + F.when(vulnerable, 1).otherwise(0)) * 14 + tricks
    known = level.between(1, 7) & tricks.between(0, 13) & (F.instr(F.lit(STRAINS), strain) > 0)
    return F.when(known, F.get(F.split(F.lit(_SCORES), ",").cast("array<int>"), place.cast("int")))


def set_score(level: Column, strain: Column, vulnerable: Column, tricks: Column) -> Column:
    """Score of a contract that takes so many tricks, doubled if it fails: what theoretical scores and expected values go by."""
    return contract_score(level, strain, F.when(tricks < level + 6, "X").otherwise(""), vulnerable, tricks - 6 - level)


def best_set_score(strain: Column, vulnerable: Column, tricks: Column) -> Column:
    """The best of the set_scores of all seven levels."""
    place = ((F.instr(F.lit(STRAINS), strain) - 1) * 2 + F.when(vulnerable, 1).otherwise(0)) * 14 + tricks
    return F.when((F.instr(F.lit(STRAINS), strain) > 0) & tricks.between(0, 13), F.get(F.split(F.lit(_BEST), ",").cast("array<int>"), place.cast("int")))
