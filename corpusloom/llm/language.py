"""Which language a text is in, told from its commonest words."""

from __future__ import annotations

import numpy as np

from corpusloom.llm.words import hash_words

#: Common function words; a word that two languages share counts for both.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on are as with be this have from or by not but what all were when we there can an your which their if will one".split(),
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind".split(),
    "fr": "le la les et des en un une du que est pour qui dans par sur au avec ce ne pas se plus il sont mais ou son cette aux nous vous leur être".split(),
    "es": "el la los las y de en que un una es por con del para se no su al lo como más pero sus le ha este sí porque esta entre cuando muy sin sobre ser".split(),
}
NAMES = [*FUNCTION_WORDS, "other"]


def vote_table() -> tuple[np.ndarray, np.ndarray]:
    """Sorted word hashes, and for each the languages it speaks for (0 or 1 a column)."""
    words = sorted({w for ws in FUNCTION_WORDS.values() for w in ws})
    votes = np.array([[w in ws for ws in FUNCTION_WORDS.values()] for w in words], np.int64)
    keys = hash_words(words)
    order = np.argsort(keys)
    return keys[order], votes[order]


def guess(hashes: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """The index in NAMES of each document's language: most votes, the first of equals; without votes "other"."""
    keys, votes = vote_table()
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    hit = np.flatnonzero(keys[at] == hashes)
    counts = np.stack([np.bincount(doc[hit], weights=v[at[hit]], minlength=docs) for v in votes.T], 1)
    return np.where(counts.max(1, initial=0) > 0, counts.argmax(1), len(NAMES) - 1)
