"""Tags: what a column means."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from enum import Enum
from typing import Any


class Tags(Enum):
    """The names that files of other tools have."""

    CATEGORICAL = "categorical"
    CONTINUOUS = "continuous"
    LIST = "list"
    SEQUENCE = "sequence"
    TEXT = "text"
    TOKENIZED = "tokenized"
    TIME = "time"
    EMBEDDING = "embedding"
    ID = "id"
    USER = "user"
    ITEM = "item"
    SESSION = "session"
    CONTEXT = "context"
    TARGET = "target"
    REGRESSION = "regression"
    CLASSIFICATION = "classification"
    BINARY = "binary"
    MULTI_CLASS = "multi_class"
    # compounds, which stand for several of the above
    USER_ID = "user_id"
    ITEM_ID = "item_id"
    SESSION_ID = "session_id"
    TEXT_TOKENIZED = "text_tokenized"
    BINARY_CLASSIFICATION = "binary_classification"
    MULTI_CLASS_CLASSIFICATION = "multi_class_classification"

    def __str__(self) -> str:
        return self.value


#: What compounds stand for; the two kinds of classification stay whole.
COMPOUNDS = {
    Tags.USER_ID: {Tags.USER, Tags.ID},
    Tags.ITEM_ID: {Tags.ITEM, Tags.ID},
    Tags.SESSION_ID: {Tags.SESSION, Tags.ID},
    Tags.TEXT_TOKENIZED: {Tags.TEXT, Tags.TOKENIZED},
}
#: Pairs of which a column can have one only.
EXCLUSIVE = [
    (Tags.CATEGORICAL, Tags.CONTINUOUS),
    (Tags.CATEGORICAL, Tags.EMBEDDING),
    (Tags.CONTINUOUS, Tags.EMBEDDING),
    (Tags.CONTINUOUS, Tags.ID),
    (Tags.EMBEDDING, Tags.ID),
]


def normalise(tag: Any) -> Tags | str:
    """The tag of a name, whatever its case; other names are tags of their own, in lower case."""
    if isinstance(tag, Tags):
        return tag
    name = str(tag).lower()
    return next((t for t in Tags if t.value == name or t.name.lower() == name), name)


def atoms(tags: Any) -> set[Tags | str]:
    """Normalised tags without compounds."""
    if tags is None:
        return set()
    if isinstance(tags, str | Tags):
        tags = [tags]
    out: set[Tags | str] = set()
    for tag in map(normalise, tags):
        out |= COMPOUNDS.get(tag, {tag})
    return out


class TagSet:
    """A set of tags without contradictions."""

    __slots__ = ("tags",)

    def __init__(self, tags: Any = None):
        self.tags = frozenset(tags.tags if isinstance(tags, TagSet) else atoms(tags))
        for a, b in EXCLUSIVE:
            if a in self.tags and b in self.tags:
                raise ValueError(f"a column is {a} or {b}, not both")

    def override(self, tags: Any) -> TagSet:
        """With further tags, which take the place of those that contradict them."""
        new = TagSet(tags)
        gone = {x for a, b in EXCLUSIVE for x, y in ((a, b), (b, a)) if y in new.tags}
        return TagSet((self.tags - gone) | new.tags)

    def __or__(self, other: Any) -> TagSet:
        return TagSet(self.tags | TagSet(other).tags)

    __add__ = __or__
    __ror__ = __or__

    def __sub__(self, other: Any) -> TagSet:
        return TagSet(self.tags - atoms(other.tags if isinstance(other, TagSet) else other))

    def __contains__(self, tag: Any) -> bool:
        return atoms(tag) <= self.tags

    def __iter__(self) -> Iterator[Tags | str]:
        return iter(sorted(self.tags, key=str))

    def __len__(self) -> int:
        return len(self.tags)

    def __eq__(self, other: object) -> bool:
        if isinstance(other, TagSet):
            return self.tags == other.tags
        return isinstance(other, Iterable) and self.tags == atoms(other)

    def __hash__(self) -> int:
        return hash(self.tags)

    def __repr__(self) -> str:
        return f"TagSet({[str(t) for t in self]})"
