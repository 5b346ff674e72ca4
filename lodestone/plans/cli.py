"""Command lines for the query tools: `search TEXT --part 1 --limit 5`, `children w:tbl --profile strict`."""

from __future__ import annotations

#: Per command: the name of its positional argument (in brackets if it may lack) and its options.
COMMANDS: dict[str, tuple[str | None, tuple[str, ...]]] = {
    "search": ("query", ("part", "limit")),
    "section": ("section_id", ("part",)),
    "parts": (None, ("part",)),
    "element": ("qname", ("profile",)),
    "type": ("qname", ("profile",)),
    "children": ("qname", ("profile",)),
    "attributes": ("qname", ("profile",)),
    "enum": ("qname", ("profile",)),
    "namespace": ("[uri]", ("query",)),
    "package_part": ("[query]", ("content_type", "relationship_type")),
    "preset_shape": ("shape", ()),
}
RANGES = {"part": (1, 4), "limit": (1, 20)}


def _number(name: str, text: str) -> int:
    low, high = RANGES[name]
    if not text.isascii() or not text.isdigit() or not low <= int(text) <= high:
        raise ValueError(f"--{name} must be a whole number from {low} to {high}, not {text}")
    return int(text)


def parse(argv: list[str]) -> tuple[str, dict]:
    """(tool, arguments); anything unknown, missing, repeated or out of range is a ValueError."""
    if not argv or argv[0].replace("-", "_") not in COMMANDS:
        raise ValueError("commands: " + ", ".join(COMMANDS))
    tool = argv[0].replace("-", "_")
    positional, options = COMMANDS[tool]
    args: dict = {}
    rest = iter(argv[1:])
    for word in rest:
        if word.startswith("--"):
            name, _, value = word[2:].partition("=")
            name = name.replace("-", "_")
            if name not in options:
                raise ValueError(f"{tool} has no option {word}")
            value = value or next(rest, "")
            if not value or name in args:
                raise ValueError(f"option {word} needs one value")
            args[name] = _number(name, value) if name in RANGES else value
        else:
            key = positional and positional.strip("[]")
            if not key or key in args:
                raise ValueError(f"{tool} takes no further argument: {word}")
            args[key] = word
    if positional and not positional.startswith("[") and positional not in args:
        raise ValueError(f"{tool} needs {positional}")
    return tool, args
