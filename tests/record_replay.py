"""Plain reading of game records, board by board, for the tests."""

import re

RANKS, SUITS = "AKQJT98765432", "SHDC"
NAMES = {"S": "spades", "H": "hearts", "D": "diamonds", "C": "clubs", "N": "nt"}


def points(level, strain, penalty, vulnerable, result):
    """Duplicate score by the rule book's wording."""
    times = {"passed": 1, "doubled": 2, "redoubled": 4}[penalty]
    if result < 0:
        total = 0
        for n in range(1, -result + 1):
            one = (100 if vulnerable else 50) if times == 1 else ((200 if n == 1 else 300) if vulnerable else (100 if n == 1 else 200 if n < 4 else 300)) * times // 2
            total -= one
        return total
    each = 20 if strain in "CD" else 30
    base = (each * level + (10 if strain == "N" else 0)) * times
    total = base + (50 if base < 100 else 500 if vulnerable else 300) + {6: 750 if vulnerable else 500, 7: 1500 if vulnerable else 1000}.get(level, 0)
    return total + {1: 0, 2: 50, 4: 100}[times] + result * (each if times == 1 else (100 if vulnerable else 50) * times)


def boards_of(text):
    fields = [(k.lower(), v.strip()) for k, v in re.findall(r"(\w\w)\|([^|]*)\|", text or "")]
    mark = "qx" if any(k == "qx" for k, _ in fields) else "md"
    names, boards = None, []
    for k, v in fields:
        if k == mark:
            boards.append([])
        if boards:
            boards[-1].append((k, v))
        if k == "pn":
            names = v
            if boards:
                boards[-1].append(("names", v))
        if k == mark and names is not None:
            boards[-1].append(("names", names))
    return boards


def board_row(fields):
    one = lambda key: next((v for k, v in fields if k == key), None)
    md = one("md") or ""
    dealer = "1234".index(md[0]) if md[:1] and md[0] in "1234" else None  # S, W, N, E
    hands = {}
    for seat, text in zip("SWNE", re.sub(r"^\d", "", md).upper().replace("10", "T").split(",") + [""] * 4):
        hands[seat] = {s + c for s in SUITS for c in (re.search(f"{s}([^SHDC]*)", text) or ["", ""])[1] if c in RANKS}
    every = {s + r for s in SUITS for r in RANKS}
    if sorted(map(len, hands.values())) == [0, 13, 13, 13] and len(set().union(*hands.values())) == 39:
        hands[next(s for s in hands if not hands[s])] = every - set().union(*hands.values())
    show = lambda seat: ".".join("".join(r for r in RANKS if s + r in hands[seat]) for s in SUITS)
    calls = [re.sub("!", "", v).upper() for k, v in fields if k == "mb"]
    kind = {"P": "passed", "D": "doubled", "R": "redoubled"}
    bids = [(i, int(c[0]), c[1]) for i, c in enumerate(calls) if re.fullmatch("[1-7](C|D|H|S|NT?)", c)]
    over = len(calls) >= 4 and calls[-3:] == ["P"] * 3 and len(bids) + sum(c in kind for c in calls) == len(calls)
    row = {"passout": not bids if over else None, "level": None, "denom": None, "penalty": None, "declarer": None, "result": None, "score": None, "contract": "PASS" if over and not bids else None}
    vul = {"o": 0, "0": 0, "-": 0, "": 0, "b": 1, "n": 2, "e": 3}.get((one("sv") or "?" if one("sv") is None else one("sv"))[:1].lower())
    played = [v.upper().replace("10", "T") for k, v in fields if k == "pc"]
    if over and bids:
        at, level, strain = bids[-1]
        first = min(i for i, _, s in bids if s == strain and (at - i) % 2 == 0)
        row |= {"level": level, "denom": NAMES[strain], "penalty": ([kind[c] for c in calls[at:] if c in "DR"] or ["passed"])[-1]}
        claim = one("mc")
        told = int(claim) if claim is not None and re.fullmatch(r"\d+", claim) and int(claim) <= 13 else None
        row["result"] = None if told is None else told - 6 - level
        if dealer is not None:
            declarer = "SWNE"[(dealer + first) % 4]
            row["declarer"] = declarer
            row["contract"] = f"{level}{strain}{ {'passed': '', 'doubled': 'X', 'redoubled': 'XX'}[row['penalty']]}{declarer}"
            tricks = None
            if claim is not None:
                tricks = told
            elif 48 <= len(played) <= 52 and all(c in every for c in played):
                tricks, leader, cards, complete = 0, "SWNE"[(dealer + first + 1) % 4], list(played), True
                for t in range(13):
                    order = [("SWNE" * 2)["SWNE".index(leader) + i] for i in range(4)]
                    if t == 12:
                        for i in range(len(cards) - 48, 4):
                            left = hands[order[i]] - set(played)
                            complete &= len(left) == 1
                            cards += left if len(left) == 1 else ["??"]
                    four = cards[4 * t : 4 * t + 4]
                    if not complete:
                        break
                    force = lambda c: (c[0] == strain, c[0] == four[0][0], -RANKS.index(c[1]))  # noqa: B023, E731
                    leader = order[max(range(4), key=lambda i: force(four[i]))]  # noqa: B023
                    tricks += leader in ("NS" if declarer in "NS" else "EW")
                tricks = tricks if complete else None
            if tricks is not None:
                row["result"] = tricks - 6 - level
                if vul is not None:
                    row["score"] = points(level, strain, row["penalty"], vul == 1 or vul == (2 if declarer in "NS" else 3), row["result"])
    names = ([v for k, v in fields if k == "names"] or [""])[-1].split(",")
    row["players"] = [(names[i].strip() or None) if i < len(names) else None for i in (2, 3, 0, 1)]
    row |= {"dealer": None if dealer is None else "SWNE"[dealer], "vulnerability": vul, "claimed": one("mc") is not None, "hands": [show(s) for s in "NESW"], "cards": played}
    return row
