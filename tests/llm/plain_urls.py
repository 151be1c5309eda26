"""Language models of URLs in memory, and their threshold: what the operator's tables are held against."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from quillstack.llm import urlmodel
from quillstack.llm.urlmodel import SYMBOLS


class Markov:
    """Witten-Bell smoothed contexts of 0 to ``order`` characters; \\x02 starts and \\x03 ends a text.

    A model in memory; the operator has the same probabilities in tables.
    """

    def __init__(self, texts: Iterable[str], order: int) -> None:
        self.order = order
        counts: dict[str, dict[str, int]] = {}
        for text in texts:
            whole = "\x02" * order + text + "\x03"
            for i in range(order, len(whole)):
                for k in range(order + 1):
                    own = counts.setdefault(whole[i - k : i], {})
                    own[whole[i]] = own.get(whole[i], 0) + 1
        #: by context: log of what is left to the next shorter one; log probabilities of what it has seen
        self.left: dict[str, float] = {}
        self.seen: dict[str, dict[str, float]] = {}
        for context in sorted(counts, key=len):
            own = counts[context]
            total = sum(own.values()) + len(own)
            share = len(own) / total
            self.left[context] = math.log(share)
            shorter = context[1:]
            self.seen[context] = {c: math.log(n / total + share * (math.exp(self._of(c, shorter)) if context else 1 / SYMBOLS)) for c, n in own.items()}

    def _of(self, c: str, context: str) -> float:
        found = 0.0
        while True:
            own = self.seen.get(context)
            if own is not None:
                if (p := own.get(c)) is not None:
                    return found + p
                found += self.left[context]
            if not context:
                return found - math.log(SYMBOLS)
            context = context[1:]

    def mean(self, text: str) -> float:
        """The log likelihood by character, the end included."""
        n = self.order
        whole = "\x02" * n + text + "\x03"
        return sum(self._of(whole[i], whole[i - n : i]) for i in range(n, len(whole))) / (len(text) + 1)


def threshold(scores: Sequence[tuple[float, bool]]) -> float:
    """The score that splits accepted from rejected with the best balanced accuracy, midway between neighbours."""
    good = sum(1 for _, ok in scores if ok)
    bad = len(scores) - good
    if not good or not bad:
        return float("-inf") if good or not bad else float("inf")
    best, at, hit, miss = -1.0, 0.0, 0, 0
    ordered = sorted(scores, reverse=True)
    for k, (score, ok) in enumerate(ordered):
        hit, miss = hit + ok, miss + (not ok)
        below = ordered[k + 1][0] if k + 1 < len(ordered) else score - 1
        if below < score and hit / good - miss / bad > best:
            best, at = hit / good - miss / bad, (score + below) / 2
    return at


def sample(urls, by_host, settings) -> dict[str, list[str]]:
    """What a bounded sample's models are fitted on and calibrated by, in turns."""
    found = urlmodel._urls(urls, by_host, settings)
    return {v: [urlmodel._normal(r["url"]) for r in urlmodel._chosen(found, v, settings).orderBy("h").collect()] for v in ("allow", "block")}
