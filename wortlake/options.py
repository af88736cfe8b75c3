"""Profiles, options and errors: plain data, kept as JSON beside the tables."""

from __future__ import annotations

import json
import os
import platform
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path


class EngineError(Exception):
    """Base of all errors here."""


class StoreError(EngineError):
    """The store's path or files are unusable."""


class ImportFailed(EngineError):
    """An archive cannot be read."""


class ProfileError(EngineError):
    """A profile is missing or exists already."""


class UnsupportedLanguage(EngineError):
    """No rules or processors for a language."""


SORT_ORDERS = ("ascending", "descending")
RESOLUTIONS = ("word", "letter")
MATCH_TYPES = ("exact", "prefix", "suffix")


def sort_order(text: str) -> str:
    """Parses a frequency order; anything else is an error."""
    if (found := text.strip().lower()) in SORT_ORDERS:
        return found
    raise EngineError(f"no such order: {text}")


@dataclass(frozen=True)
class DictionaryOptions:
    name: str
    alias: str = ""
    enabled: bool = True
    allow_secondary_searches: bool = True
    parts_of_speech_filter: bool = False
    use_deinflections: bool = True

    @classmethod
    def of_profile(cls, name: str) -> DictionaryOptions:
        """The defaults of a profile: the alias is the name and secondary searches are off."""
        return cls(name, alias=name, allow_secondary_searches=False)


@dataclass(frozen=True)
class LookupOptions:
    """What a lookup needs; see plans.pipeline."""

    match_type: str = "exact"
    deinflect: bool = True
    primary_reading: str = ""
    main_dictionary: str = ""
    sort_frequency_dictionary: str | None = None
    sort_frequency_order: str = "ascending"
    remove_non_japanese: bool = False
    excluded: tuple[str, ...] = ()
    search_resolution: str = "word"
    text_replacements: tuple[tuple[tuple[str, str, bool], ...], ...] = ()


@dataclass
class CardTarget:
    """A note target: decks and models by name, the chosen ones, and what goes into which field."""

    decks: dict[str, int] = field(default_factory=dict)
    models: dict[str, list[str]] = field(default_factory=dict)
    deck: str = ""
    model: str = ""
    fields: dict[str, str] = field(default_factory=dict)

    def select(self, deck: int | str, model: int | str) -> CardTarget:
        """Chooses a deck and a model by name or index."""
        return replace(self, deck=_named(list(self.decks), deck, "deck"), model=_named(list(self.models), model, "model"))

    def map_fields(self, mapping: dict[str, str]) -> CardTarget:
        """Maps kinds of content (term, reading, definition, sentence, ...) to fields of the chosen model."""
        known = self.models.get(self.model, [])
        if unknown := [f for f in mapping.values() if f not in known]:
            raise EngineError(f"model {self.model!r} has no field {unknown}")
        return replace(self, fields=dict(mapping))

    def configured(self) -> CardTarget:
        """Maps what the field names of the chosen model suggest."""
        wanted = {"term": ("expression", "term", "word", "front"), "reading": ("reading",), "definition": ("definition", "meaning", "glossary", "back"), "sentence": ("sentence", "context")}
        names = {f.lower(): f for f in self.models.get(self.model, [])}
        return replace(self, fields={kind: names[n] for kind, options in wanted.items() for n in options[:] if n in names})


def _named(names: list[str], wanted: int | str, what: str) -> str:
    if isinstance(wanted, int):
        if not 0 <= wanted < len(names):
            raise EngineError(f"{what} index {wanted} is out of bounds")
        return names[wanted]
    if wanted not in names:
        raise EngineError(f"no {what} {wanted!r}")
    return wanted


@dataclass
class Profile:
    name: str = "Default"
    language: str = "ja"
    main_dictionary: str = ""
    dictionaries: list[DictionaryOptions] = field(default_factory=list)
    lookup: LookupOptions = field(default_factory=LookupOptions)
    cards: CardTarget = field(default_factory=CardTarget)

    def merge_dictionaries(self, new: list[DictionaryOptions]) -> None:
        """Adds options of imported dictionaries; those of known names stay. The first one becomes the main one if there is none."""
        known = {d.name for d in self.dictionaries}
        self.dictionaries += [d for d in new if d.name not in known]
        if not self.main_dictionary and new:
            self.main_dictionary = new[0].name

    def lookup_options(self) -> LookupOptions:
        return replace(self.lookup, main_dictionary=self.main_dictionary)


@dataclass
class Settings:
    profiles: list[Profile] = field(default_factory=lambda: [Profile()])
    current: int = 0

    @property
    def profile(self) -> Profile:
        return self.profiles[self.current]

    def by_name(self, name: str) -> Profile:
        found = next((p for p in self.profiles if p.name == name), None)
        if found is None:
            raise ProfileError(f"no profile {name!r}")
        return found

    def create_profile(self, name: str | None = None) -> Profile:
        """A copy of the first profile under a new name; without a name one is made."""
        taken = {p.name for p in self.profiles}
        if name is None:
            name = next(n for i in range(1, len(taken) + 2) if (n := f"Profile {i}") not in taken)
        if name in taken:
            raise ProfileError(f"profile {name!r} exists")
        made = replace(self.profiles[0], name=name, dictionaries=list(self.profiles[0].dictionaries))
        self.profiles.append(made)
        return made

    def remove_dictionaries(self, names: list[str], *, everywhere: bool = False) -> None:
        """Removes dictionaries by name from the current profile, or from all."""
        for profile in self.profiles if everywhere else [self.profile]:
            profile.dictionaries = [d for d in profile.dictionaries if d.name not in names]
            if profile.main_dictionary in names:
                profile.main_dictionary = ""

    def remove_by_index(self, indexes: list[int]) -> None:
        self.remove_dictionaries([d.name for i, d in enumerate(self.profile.dictionaries) if i in indexes])

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, indent=1)

    @classmethod
    def from_json(cls, text: str) -> Settings:
        raw = json.loads(text)
        profiles = []
        for p in raw["profiles"]:
            lookup = dict(p["lookup"], excluded=tuple(p["lookup"]["excluded"]), text_replacements=tuple(tuple(map(tuple, g)) for g in p["lookup"]["text_replacements"]))
            profiles.append(Profile(p["name"], p["language"], p["main_dictionary"], [DictionaryOptions(**d) for d in p["dictionaries"]], LookupOptions(**lookup), CardTarget(**p["cards"])))
        return cls(profiles, raw["current"])

    def save(self, path: str | os.PathLike) -> None:
        Path(path).write_text(self.to_json(), encoding="utf-8")

    @classmethod
    def load(cls, path: str | os.PathLike) -> Settings:
        """The saved settings, or the defaults if there are none."""
        return cls.from_json(Path(path).read_text(encoding="utf-8")) if Path(path).exists() else cls()


def environment() -> str:
    """The operating system's name."""
    return platform.system().lower()
