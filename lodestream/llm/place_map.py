"""Free-entered places mapped to the entries of a reference list.

The reference entries and their alias paths form a trie. Every typed piece is searched in it with a Levenshtein
automaton (adjacent transpositions count as one edit) that returns all entries within a distance that depends on
the piece's length. What the other pieces say about region and country then decides between the entries.

Scale: companies are read in one narrow stage without a shuffle, and each task searches a distinct piece once, so
that a value a third of all rows share costs nothing extra. The trie is shipped to the tasks; it is built from a
reference list whose size is checked against MAX_ENTRIES, not from the data.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.config import STATE_CODES as US_STATES

#: The reference list is kept in memory by every task; a longer one is refused.
MAX_ENTRIES = 1_000_000
#: Distinct pieces that a task remembers; others are searched again.
MEMORY = 200_000

# Names and codes of countries, by two-letter code.
COUNTRIES = {
    "us": ("us", "u s", "usa", "u s a", "united states", "united states of america", "america", "estados unidos", "etats unis", "vereinigte staaten"),
    "gb": ("gb", "uk", "u k", "united kingdom", "great britain", "britain", "gbr"),
    "de": ("de", "deu", "ger", "germany", "deutschland", "allemagne", "alemania"),
    "fr": ("fr", "fra", "france", "frankreich", "francia"),
    "es": ("es", "esp", "spain", "espana", "spanien"),
    "se": ("se", "swe", "sweden", "sverige", "schweden"),
    "ca": ("ca", "can", "canada", "kanada"),
    "au": ("au", "aus", "australia", "australien"),
    "in": ("in", "ind", "india", "bharat", "indien"),
    "it": ("it", "ita", "italy", "italia"),
    "nl": ("nl", "nld", "netherlands", "the netherlands", "nederland", "holland"),
    "ch": ("ch", "che", "switzerland", "schweiz", "suisse"),
    "at": ("at", "aut", "austria", "osterreich"),
    "be": ("be", "bel", "belgium", "belgique", "belgie"),
    "ie": ("ie", "irl", "ireland"),
    "br": ("br", "bra", "brazil", "brasil"),
    "mx": ("mx", "mex", "mexico"),
    "jp": ("jp", "jpn", "japan", "nippon"),
    "cn": ("cn", "chn", "china"),
    "pt": ("prt", "portugal"),
    "dk": ("dk", "dnk", "denmark", "danmark"),
    "no": ("nor", "norway", "norge"),
    "fi": ("fi", "fin", "finland", "suomi"),
    "pl": ("pl", "pol", "poland", "polska"),
    "sg": ("sg", "sgp", "singapore"),
    "nz": ("nz", "nzl", "new zealand"),
}

# Short forms of the first word of a place name.
FIRST_WORDS = {"st": "saint", "ste": "sainte", "mt": "mount", "ft": "fort", "pt": "port", "n": "north", "no": "north", "s": "south", "so": "south", "e": "east", "w": "west", "lk": "lake", "upr": "upper"}

_PIECES = re.compile(r"[,/;|()\[\]\n]|\s[-–—]\s")
_COUNTRY_OF = {name: code for code, names in COUNTRIES.items() for name in names}


def fold(text: str) -> str:
    """Lower case without accents, punctuation and repeated blanks."""
    plain = "".join(ch for ch in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(ch))
    return " ".join(re.sub(r"[^\w\s]|_", " ", plain).split())


def place_name(folded: str) -> str:
    """A folded name with its short first word spelt out."""
    words = folded.split()
    if len(words) > 1 and words[0] in FIRST_WORDS:
        words[0] = FIRST_WORDS[words[0]]
    return " ".join(words)


def allowed_distance(length: int) -> int:
    """Names of up to 3 letters must be exact, up to 11 may have one edit, longer ones two."""
    return 0 if length <= 3 else 1 if length <= 11 else 2


class NameTrie:
    """Trie of names; ``search`` runs a Levenshtein automaton over it, pruning dead states."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, name: str, entry: int) -> None:
        node = self.root
        for ch in name:
            node = node.setdefault(ch, {})
        node.setdefault("", set()).add(entry)

    def search(self, word: str, k: int) -> list[tuple[int, int]]:
        """(entry, distance) of all entries with a name within k edits, each with its least distance.

        The automaton's states are bit masks: bit j of mask d is set if j letters of the word can be read with d edits
        by the path so far. ``swapped`` has the positions from which the later of two swapped letters was just read.
        """
        n = len(word)
        if k == 0:
            node = self.root
            for ch in word:
                node = node.get(ch)
                if node is None:
                    return []
            return sorted((e, 0) for e in node.get("", ()))
        reads: dict[str, int] = {}
        for j, ch in enumerate(word):
            reads[ch] = reads.get(ch, 0) | 2 << j
        full, goal = (2 << n) - 1, 1 << n
        best: dict[int, int] = {}
        start = tuple((2 << d) - 1 & full for d in range(k + 1))
        stack = [(self.root, start, (0,) * (k + 1))]
        while stack:
            node, state, swapped = stack.pop()
            for ch, child in node.items():
                if not ch:
                    for d in range(k + 1):
                        if state[d] & goal:
                            for entry in child:
                                best[entry] = min(best.get(entry, d), d)
                            break
                    continue
                m = reads.get(ch, 0)
                masks, swaps, last, alive = [], [], 0, 0
                for d in range(k + 1):
                    now = state[d] << 1 & m
                    swap = 0
                    if d:
                        low = state[d - 1]
                        # the letter is read in excess, in place of another, or before it a letter is left out
                        now |= (low | low << 1 | last << 1 | (swapped[d] & m >> 1) << 2) & full
                        swap = low & m >> 2
                    masks.append(now)
                    swaps.append(swap)
                    last = now
                    alive |= now | swap
                if alive:
                    stack.append((child, tuple(masks), tuple(swaps)))
        return sorted(best.items())

    def nearest(self, word: str, k: int) -> list[tuple[int, int]]:
        """Of the entries within k edits those at the least distance; a close one spares the wider search."""
        for d in range(k + 1):
            if found := self.search(word, d):
                return found
        return []


class PlaceIndex:
    """The reference list with its trie, regions and countries."""

    def __init__(self, places: list[tuple]) -> None:
        """``places``: (place_id, city, region, country, aliases)."""
        self.trie = NameTrie()
        self.region: dict[int, str] = {}
        self.country: dict[int, str] = {}
        self.known_regions: set[str] = set(US_STATES.values())
        for place_id, city, region, country, aliases in places:
            self.region[place_id] = self.region_code(fold(region or ""))
            self.country[place_id] = _COUNTRY_OF.get(fold(country or ""), fold(country or ""))
            self.known_regions.add(self.region[place_id])
            for name in [city, *(aliases if aliases is not None else [])]:
                if name and name.strip():
                    self.trie.add(place_name(fold(name)), place_id)
        self.known_regions.discard("")
        self.region_country = dict.fromkeys(US_STATES.values(), "us") | {r: self.country[i] for i, r in self.region.items() if r}
        self.read = lru_cache(MEMORY)(self._read)

    @staticmethod
    def region_code(folded: str) -> str:
        return US_STATES.get(folded, folded)

    def _read(self, piece: str) -> tuple[tuple, str, str]:
        """(nearest entries with distance, region or '', country or '') that a piece can stand for."""
        folded = re.sub(r"^(?:hq|head office|headquarters)\s+", "", fold(piece))
        folded = re.sub(r"^greater\s+(.*?)(?:\s+area)?$", r"\1", folded)
        folded = re.sub(r"\s+(?:metro|metro area|metropolitan area|area|region)$", "", folded)
        named = re.sub(r"\s+\d[\d ]*$", "", folded)
        if not named or re.search(r"\d", named):
            return (), "", ""
        region = self.region_code(named)
        country = _COUNTRY_OF.get(named, "")
        region = region if region in self.known_regions else ""
        name = place_name(named)
        # A region's or country's name is a town only if it is exactly a town's name.
        found = self.trie.nearest(name, 0 if region or country else allowed_distance(len(name)))
        return tuple(found), region, country

    def resolve(self, headquarters, city, region, country) -> tuple[int, str] | None:
        """(place_id, verdict), or None if all four fields are blank."""
        fields = [x for x in (headquarters, city, region, country)]
        if all(x is None or not str(x).strip() for x in fields):
            return None
        readings = []
        for i, field in enumerate(fields):
            for piece in _PIECES.split(field or ""):
                if not piece.strip():
                    continue
                found, reg, ctry = self.read(piece)
                if i == 3 and ctry:
                    found, reg = (), ""  # the country field's codes are countries
                readings.append((found, reg, ctry))
        towns = [found for found, reg, ctry in readings if found]
        if not towns:
            return 0, "unlisted"
        near: dict[int, int] = {}
        for i, found in enumerate(towns):
            least = min(d for _, d in found)
            here = {e: d for e, d in found if d == least}
            near = here if i == 0 else {e: d + here[e] for e, d in near.items() if e in here}
        if not near:
            return 0, "contradiction"
        for found, reg, ctry in readings:
            if not found and (reg or ctry):
                near = {e: d for e, d in near.items() if (reg and self.region[e] == reg) or (ctry and self.country[e] == ctry)}
        if not near:
            return 0, "contradiction"
        return (next(iter(near)), "listed") if len(near) == 1 else (0, "ambiguous")


_BUILT: dict[str, PlaceIndex] = {}


class SharedIndex:
    """The reference list as a broadcast variable; a worker builds its index once, not once a task."""

    def __init__(self, places: DataFrame) -> None:
        """``places``: place_id, city, region, country, aliases; an error if it has more than MAX_ENTRIES rows."""
        listed = places.select("place_id", "city", "region", "country", "aliases").filter(F.col("place_id").isNotNull()).limit(MAX_ENTRIES + 1).collect()
        if len(listed) > MAX_ENTRIES:
            raise ValueError(f"the reference list has more than {MAX_ENTRIES} entries")
        self.name = uuid.uuid4().hex
        self.rows: Broadcast = places.sparkSession.sparkContext.broadcast([tuple(r) for r in listed])

    def get(self) -> PlaceIndex:
        if self.name not in _BUILT:
            _BUILT.clear()
            _BUILT[self.name] = PlaceIndex(self.rows.value)
        return _BUILT[self.name]


def match_places(companies: DataFrame, places: DataFrame) -> DataFrame:
    """discovery_company_id, place_id, verdict of each company with at least one head-office field not blank.

    ``verdict`` is listed, unlisted (no town within the distance), contradiction (the fields exclude every listed
    place) or ambiguous (several fit and nothing in the row decides); place_id is 0 for all but listed. Null and
    blank fields say nothing; numbers are streets and post codes. Fields may be of any length. Repeated rows
    count once; rows of one id that disagree give the listed place of the greatest place_id. Empty tables are allowed: an
    empty reference list makes every company unlisted. Other columns are ignored.
    """
    shared = SharedIndex(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.get()
        for batch in batches:
            ids, *fields = (c.to_pylist() for c in batch.columns)
            out = [(i, *v) for i, *f in zip(ids, *fields) if (v := index.resolve(*f)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], names=["discovery_company_id", "place_id", "verdict"])

    found = companies.select("id", "headquarters", "hq_city", "hq_region", "hq_country").mapInArrow(run, "discovery_company_id string, place_id long, verdict string")
    return found.groupBy("discovery_company_id").agg(F.max(F.struct("place_id", "verdict")).alias("m")).select("discovery_company_id", "m.place_id", "m.verdict")


def unmatched_report(companies: DataFrame, places: DataFrame) -> DataFrame:
    """Entered head offices that fit no listed place, with the verdict and the number of companies."""
    rows = companies.select(F.col("id").alias("discovery_company_id"), *(F.trim(c).alias(c) for c in ("headquarters", "hq_city", "hq_region", "hq_country"))).dropDuplicates(["discovery_company_id"])
    bad = match_places(companies, places).filter(F.col("place_id") == 0)
    return rows.join(bad, "discovery_company_id").groupBy("headquarters", "hq_city", "hq_region", "hq_country", "verdict").agg(F.count(F.lit(1)).alias("n_companies"))
