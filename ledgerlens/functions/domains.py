"""DNS names: normal form, registrable domain, parents."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Public suffixes of more than one label; every other name has its last label as suffix (the rules' default).
#: A deployment parses a rule file of its own, see ``SuffixRules``.
SUFFIXES: tuple[str, ...] = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "net.uk",
    "com.au", "net.au", "org.au",
    "co.jp", "ne.jp", "or.jp",
    "co.nz", "com.br", "com.cn", "co.in", "co.za",
)


def normalised(names: Column) -> Column:
    """Lower case, without a leading ``*.`` or ``*``, without empty names, each once."""
    return F.array_distinct(F.filter(F.transform(names, lambda x: F.regexp_replace(F.lower(x), r"^\*\.?", "")), lambda x: x != ""))


@dataclass(frozen=True)
class SuffixRules:
    """Public suffix rules: plain ones, wildcards (of ``*.ck`` the part ``ck``: every label before it makes a suffix) and exceptions to these.

    A name's suffix is that of the longest rule that holds; without one it is the last label. ``version`` tells lists apart.
    """

    plain: frozenset[str]
    wildcards: frozenset[str] = frozenset()
    exceptions: frozenset[str] = frozenset()

    @classmethod
    def parse(cls, text: str) -> SuffixRules:
        """From the text of a rule file: a rule a line up to the first blank, ``//`` before comments, ``!`` before exceptions."""
        plain, wildcards, exceptions = set(), set(), set()
        for line in text.splitlines():
            rule = line.split()[0].lower().lstrip(".") if line.strip() and not line.lstrip().startswith("//") else ""
            rule = "!" + _ascii(rule[1:]) if rule.startswith("!") else _ascii(rule)
            if rule.startswith("!"):
                exceptions.add(rule[1:])
            elif rule.startswith("*."):
                wildcards.add(rule[2:])
            elif rule and "*" not in rule:
                plain.add(rule)
        return cls(frozenset(plain), frozenset(wildcards), frozenset(exceptions))

    @property
    def version(self) -> str:
        rules = sorted(self.plain) + [f"*.{r}" for r in sorted(self.wildcards)] + [f"!{r}" for r in sorted(self.exceptions)]
        return hashlib.sha256("\n".join(rules).encode()).hexdigest()


def _ascii(name: str) -> str:
    """The form that certificates and hosts have."""
    return name if name.isascii() else ".".join(x.encode("idna").decode() if x and not x.isascii() else x for x in name.split("."))


DEFAULT = SuffixRules(frozenset(SUFFIXES))


def registrable_labels(name: Column, rules: SuffixRules = DEFAULT) -> Column:
    """The number of labels of the registrable domain: one more than the public suffix has; 0 if the name is a suffix itself."""
    n = F.size(F.split(name, r"\."))
    by_labels = lambda rules, k: sorted(r for r in rules if r.count(".") + 1 == k)
    end = lambda k: F.substring_index(name, ".", -k)
    longest = max([r.count(".") + 1 for r in rules.plain | rules.exceptions] + [r.count(".") + 2 for r in rules.wildcards] + [1])
    need: Column = F.lit(2)
    for k in range(1, longest + 1):  # a longer rule goes before a shorter one, an exception before any
        holds = F.lit(False)
        if own := by_labels(rules.plain, k):
            holds = holds | end(k).isin(own)
        if k > 1 and (own := by_labels(rules.wildcards, k - 1)):
            holds = holds | end(k - 1).isin(own)
        need = F.when((n >= k) & holds, k + 1).otherwise(need)
    for k in range(1, longest + 1):
        if own := by_labels(rules.exceptions, k):
            need = F.when((n >= k) & end(k).isin(own), k).otherwise(need)
    return F.when(n >= need, need).otherwise(0)


def with_parents(names: Column, rules: SuffixRules = DEFAULT) -> Column:
    """Every name with its ancestors down to the registrable domain, each once, sorted; a bare suffix stands for itself."""

    def expand(name: Column) -> Column:
        parts = F.split(name, r"\.")
        least = registrable_labels(name, rules)
        return F.when(least == 0, F.array(name)).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - least, F.lit(0))), lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "."))
        )

    return F.array_sort(F.array_distinct(F.flatten(F.transform(normalised(names), expand))))
