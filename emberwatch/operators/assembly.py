"""Which incident takes which alert: the walk through one component of alerts.

Alerts and incidents meet through indexes by value. One lookup of an alert's values tells, for every
holder at once, which kinds of value are in common; strength follows from these kinds, so no alert is
compared with an incident it shares nothing with. The walk only decides membership and says what
was in common; sentences are column expressions made from that."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import pandas as pd

HOST, USER, SOURCE, OUTSIDE, NAMED = 1, 2, 4, 8, 16
KINDS = {"hosts": HOST, "users": USER, "sources": SOURCE, "external": OUTSIDE}
#: An alert's own fields, and the sets of an incident in which they are looked for.
FIELDS = {"host": "hosts", "source_ip": "sources", "username": "users", "target_username": "users"}
TAKEN_SCHEMA = (
    "incident_id string, alert_id string, position int, strength string, h array<string>, u array<string>, "
    "s array<string>, new array<string>, gap long, foothold string, since long, title string, severe boolean, "
    "partners int, new_incident boolean"
)


class Index:
    """Numbers of those that hold a (column, value)."""

    def __init__(self) -> None:
        self.holders: dict[tuple, set[int]] = defaultdict(set)

    def add(self, number: int, values: Iterable[tuple]) -> None:
        for v in values:
            self.holders[v].add(number)

    def drop(self, number: int, values: Iterable[tuple]) -> None:
        for v in values:
            self.holders[v].discard(number)

    def shared(self, values: Iterable[tuple]) -> dict[int, int]:
        """number -> the kinds of value in common, as bits."""
        found: dict[int, int] = defaultdict(int)
        for v in values:
            kind = KINDS.get(v[0], NAMED)
            for number in self.holders.get(v, ()):
                found[number] |= kind
        return found


def _values(facts: dict) -> list[tuple]:
    return [(c, v) for c in KINDS for v in facts[c]]


class Walk:
    """One component: its alerts in order of time, its incidents as they grow."""

    def __init__(self, rows: pd.DataFrame, window: int, sequence_window: int) -> None:
        self.window, self.sequence_window = window, sequence_window
        rows = rows.sort_values(["first_us", "last_us", "rule_id", "id"])
        self.alerts = [self._alert(r) for r in rows.to_dict("records")]
        self.incidents: list[dict] = []
        self.waiting, self.live = Index(), Index()
        self.taken: list[tuple] = []
        known: dict[str, int] = {}
        for k, a in enumerate(self.alerts):
            if a["prior"] is not None:
                if a["prior"] not in known:
                    known[a["prior"]] = self._start(a["prior"], bool(a["incident_open"]))
                self._grow(known[a["prior"]], a)
            elif a["open"]:
                self.waiting.add(k, a["values"] + a["own"])
                a["free"] = True
        self.touched: set[int] = set()

    @staticmethod
    def _alert(r: dict) -> dict:
        a = {c: set(r[c]) for c in ("hosts", "users", "sources", "external", "techniques")}
        a |= {c: r[c] for c in ("id", "title", "first_us", "last_us", "open", "incident_open")}
        a["own"] = [(c, r[c]) for c in FIELDS if isinstance(r[c], str) and r[c]]
        a["values"] = _values(a)
        a["since"] = dict.fromkeys(a["hosts"], r["first_us"]) if r["access"] else {}
        a["severe"], a["free"] = r["severity"] in ("high", "critical"), False
        a["prior"] = r["prior"] if isinstance(r["prior"], str) else None
        a["apart"] = set(r["apart"]) if r["apart"] is not None else set()
        return a

    def _start(self, name: str, accepts: bool, origin: dict | None = None, partners: int = 0) -> int:
        empty = {c: set() for c in ("hosts", "users", "sources", "external", "techniques")}
        told = (origin["title"], origin["severe"], partners) if origin else (None, None, None)
        self.incidents.append(
            empty | {"name": name, "accepts": accepts, "since": {}, "first_us": 2**62, "last_us": -(2**62), "size": 0, "told": told}
        )
        return len(self.incidents) - 1

    def _grow(self, number: int, a: dict) -> None:
        inc = self.incidents[number]
        for c in ("hosts", "users", "sources", "external", "techniques"):
            inc[c] |= a[c]
        for host, us in a["since"].items():
            inc["since"][host] = min(us, inc["since"].get(host, us))
        inc["first_us"], inc["last_us"] = min(inc["first_us"], a["first_us"]), max(inc["last_us"], a["last_us"])
        inc["size"] += 1
        if inc["accepts"]:
            self.live.add(number, a["values"])

    def _take(self, number: int, k: int, found: tuple, new: bool) -> None:
        """`found`: what alert and incident had in common before."""
        a = self.alerts[k]
        self._grow(number, a)
        a["free"] = False
        self.waiting.drop(k, a["values"] + a["own"])
        self.touched.add(number)
        inc = self.incidents[number]
        self.taken.append((inc["name"], a["id"], inc["size"], *found, *inc["told"], new))

    def _tie(self, kinds: int, a: dict, other: dict) -> tuple | None:
        """How an alert is tied to another one or to an incident, given the kinds of value that both have."""
        gap = max(a["first_us"] - other["last_us"], other["first_us"] - a["last_us"], 0)
        if gap > self.window:
            return None
        new = a["techniques"] - other["techniques"]
        foothold = None
        if kinds & HOST and kinds & (USER | SOURCE):
            strength = "STRONG"
        elif kinds & OUTSIDE:
            strength = "MEDIUM"
        elif kinds & HOST and new and gap <= self.sequence_window:
            seen = (h for h, us in other["since"].items() if h in a["hosts"] and us <= a["first_us"])
            foothold, strength = min(seen, default=None), "MEDIUM"
            if foothold is None:
                return None
        else:
            return None
        common = (sorted(a[c] & other[c]) for c in ("hosts", "users", "sources"))
        return strength, *common, sorted(new), gap, foothold, other["since"].get(foothold)

    def _waiting_for(self, other: dict, named: list[tuple], but: int = -1) -> list[tuple[int, tuple]]:
        """Free alerts tied to an alert or incident that names one of their own fields, in order."""
        kinds = self.waiting.shared(_values(other) + named)
        near = sorted(k for k, bits in kinds.items() if bits & NAMED and k != but)
        ties = ((k, self._tie(kinds[k], self.alerts[k], other)) for k in near)
        return [(k, tie) for k, tie in ties if tie]

    def _settle(self, k: int) -> None:
        a = self.alerts[k]
        offers = []
        for number, kinds in self.live.shared(a["values"]).items():
            inc = self.incidents[number]
            if inc["name"] in a["apart"]:
                continue
            if tie := self._tie(kinds, a, inc):
                offers.append((tie[0] == "STRONG", inc["last_us"], -number, tie))
            elif a["first_us"] - inc["last_us"] > self.window:  # later alerts begin later still
                self.live.drop(number, _values(inc))
        if offers:
            *_, number, tie = max(offers, key=lambda o: o[:3])
            self._take(-number, k, tie, False)
            return
        partners = self._waiting_for(a, [f for f in a["own"] if f[0] != "target_username"], but=k)
        if a["severe"] or partners:
            number = self._start(f"inc-{a['id']}", True, a, len(partners))
            self._take(number, k, ("ORIGIN", [], [], [], [], 0, None, None), True)
            for other, tie in partners:
                self._take(number, other, tie, True)

    def run(self) -> pd.DataFrame:
        for k, a in enumerate(self.alerts):
            if a["free"]:
                self._settle(k)
        for number in sorted(self.touched):
            inc = self.incidents[number]
            while found := [
                (k, tie)
                for k, tie in self._waiting_for(inc, [(f, v) for f, c in FIELDS.items() for v in inc[c]])
                if inc["name"] not in self.alerts[k]["apart"]
            ]:
                for k, tie in found:
                    self._take(number, k, tie, False)
        return pd.DataFrame(self.taken, columns=[c.split()[0] for c in TAKEN_SCHEMA.split(", ")])
