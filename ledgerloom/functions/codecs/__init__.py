"""Text forms of JSON payloads, by name."""

from __future__ import annotations

from typing import Protocol


class Ineligible(ValueError):
    """A payload has no exact form in a codec."""


class Codec(Protocol):
    name: str
    version: str
    primer: str

    def check(self, value: object, union: bool = False) -> None: ...

    def encode(self, value: object, union: bool = False) -> str: ...

    def both(self, value: object, canonical: str, union: bool = False) -> tuple[str, str | None]:
        """The encoding, and the canonical text that it was decoded to if the codec checks that it is the same."""

    def decode(self, text: str) -> object: ...

    def lossless(self, union: bool) -> bool: ...

    def primer_for(self, blocks: list[str]) -> str: ...


CODECS: dict[str, Codec] = {}


def register(codec: Codec) -> Codec:
    if codec.name in CODECS:
        raise ValueError(f"codec {codec.name} is there already")
    CODECS[codec.name] = codec
    return codec


def verified(codec: Codec, text: str, canonical: str) -> tuple[str, str]:
    """text and what it decodes to, if that is the very document."""
    from .. import jsonlex as J

    try:
        back = J.write(codec.decode(text))
    except ValueError:
        back = None
    if back != canonical:
        raise Ineligible("round trip failed")
    return text, back


def names() -> list[str]:
    return sorted(CODECS)


from . import tabular, toon, toonx  # noqa: E402, F401
