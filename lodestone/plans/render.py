"""Markdown reports of small results, built on the driver."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Row

#: The parts of the specification.
PARTS = {1: "Fundamentals and Markup Language Reference", 2: "Open Packaging Conventions", 3: "Markup Compatibility and Extensibility", 4: "Transitional Migration Features"}


def part_name(number: int) -> str:
    return PARTS.get(number, f"Part {number}")


def occurs(row: Row) -> str:
    return f"{row['min_occurs']}..{'unbounded' if row['max_occurs'] is None else row['max_occurs']}"


def bullets(lines: Iterable[str], none: str) -> str:
    found = [f"- {x}" for x in lines]
    return "\n".join(found) if found else none


def symbol(title: str, hit: Row, profile: str) -> str:
    rows = [f"Namespace: `{hit['namespace_uri']}`", f"Vocabulary: `{hit['vocabulary_id']}`", f"Profile: {profile}"]
    if hit["type_ref"]:
        rows.append(f"Type: `{hit['type_ref']}`")
    if hit["source_name"]:
        rows.append(f"Source: {hit['source_name']}")
    return f"## {title} `{hit['local_name']}`\n\n" + bullets(rows, "")


def not_found(what: str, profile: str | None = None, alternatives: Iterable[Row] = ()) -> str:
    text = f"Not found: {what}" + (f" (profile {profile})" if profile else "") + "."
    others = [f"`{{{r['namespace_uri']}}}{r['local_name']}` ({r['kind']}, {r['vocabulary_id']})" for r in alternatives]
    return text + ("\n\nDid you mean:\n" + bullets(others, "") if others else "")


def local_element(name: str, found: list[Row], profile: str) -> str:
    owners = [f"in {r['owner_kind']} `{r['owner_name']}`" for r in found]
    return f"## Local element `{name}`\n\nType: `{found[0]['type_ref']}` (profile {profile})\n\nDeclared\n{bullets(owners, '')}"


def ambiguous(name: str, found: list[Row]) -> str:
    owners = [f"`{r['owner_name']}` ({r['owner_kind']}): type `{r['type_ref'] or '(none)'}`" for r in found]
    return f"`{name}` is ambiguous: its local declarations disagree.\n\n{bullets(owners, '')}\n\nAsk for one of the types instead."


def children(owner: Row, rows: list[Row], note: str = "") -> str:
    lines = []
    for r in rows:
        where = " > ".join(r["compositor_path"]) or "directly"
        origin = "" if r["source"] == "self" else f", inherited from `{r['owner_name']}`"
        lines.append(f"{'group ' if r['entry'] == 'group' else ''}`{r['local_name']}` [{occurs(r)}] in {where}{origin}")
    return f"## Children of `{owner['local_name']}`\n\n{note}" + bullets(lines, "No child elements.")


def attributes(owner: Row, rows: list[Row], note: str = "") -> str:
    lines = []
    for r in rows:
        values = "".join(f", {k} `{r[c]}`" for k, c in (("default", "default_value"), ("fixed", "fixed_value")) if r[c] is not None)
        origin = {"self": "", "inherited": f", inherited from `{r['owner_name']}`", "attributeGroup": f", from attributeGroup `{r['owner_name']}`"}[r["source"]]
        lines.append(f"`{r['local_name']}` ({r['attr_use']}): `{r['type_ref'] or '(unknown)'}`{values}{origin}")
    return f"## Attributes of `{owner['local_name']}`\n\n{note}" + bullets(lines, "No attributes.")


def enums(owner: Row, rows: list[Row]) -> str:
    return f"## Values of `{owner['local_name']}`\n\n" + bullets((f"`{r['value']}`" for r in rows), "No enumerated values.")


def namespaces(title: str, rows: list[Row], note: str = "") -> str:
    lines = [f"`{r['uri']}`: {', '.join(r['vocabularies'])}; " + ", ".join(f"{p['name']} {p['symbol_count']}" for p in r["profiles"]) for r in rows]
    return f"## {title}\n\n{note}" + bullets(lines, "No namespaces.")


def package_part(row: Row) -> str:
    lines = [f"Key: `{row['key']}`", "Content type: " + ", ".join(f"`{x}`" for x in row["content_types"]), f"Relationship: `{row['relationship_type']}`"]
    if row["root_element"]:
        lines.append(f"Root: `{{{row['root_namespace']}}}{row['root_element']}`")
    lines += ["Paths: " + ", ".join(f"`{x}`" for x in row["typical_paths"]), "Sections: " + "; ".join(row["source_sections"]), "Packages: " + ", ".join(row["families"])]
    return f"## {row['name']}\n\n" + bullets(lines, "") + (f"\n\n{row['notes']}" if row["notes"] else "")


def package_parts(title: str, rows: list[Row], footer: str = "") -> str:
    return f"## {title}\n\n" + bullets((f"{r['name']} (`{r['key']}`): {', '.join(r['content_types'])}" for r in rows), "No parts.") + footer


def shape(name: str, guides: list[str] | None) -> str:
    if guides is None:
        return f"No preset shape is named '{name}'. Names are matched exactly."
    if not guides:
        return f"## Preset shape `{name}`\n\nThe shape has no adjust guides."
    return f"## Preset shape `{name}`\n\n" + bullets((f"`{g}`" for g in guides), "")


def search_results(query: str, rows: list[Row]) -> str:
    if not rows:
        return f'Nothing found for "{query}".'
    blocks = [f"### {r['section_id'] or 'Section'}: {r['title'] or 'Untitled'}\n**Part {r['part_number']}**, {part_name(r['part_number'])} ({(r['score'] or 0) * 100:.1f}%)\n\n{r['content']}" for r in rows]
    return f'## Results for "{query}"\n\n' + "\n\n---\n\n".join(blocks)


def section_results(section_id: str, rows: list[Row], more: str | None = None) -> str:
    if not rows:
        return f'Section "{section_id}" not found.'
    blocks = [(f"### {r['title']}\n" if r["title"] else "") + f"**Part {r['part_number']}**, {part_name(r['part_number'])}\n\n{r['content']}" for r in rows]
    return f"## Section {section_id}\n\n" + "\n\n".join(blocks) + (f"\n\nMore follows; ask again with after `{more}`." if more else "")


def part_listing(rows: list[Row], part: int | None) -> str:
    head = f"## Part {part}: {part_name(part)}" if part is not None else "## Parts\n\n" + bullets((f"**Part {n}**: {x}" for n, x in PARTS.items()), "")
    out, now = [head], None
    for r in rows:
        if r["part_number"] != now and part is None:
            out.append(f"\n### Part {r['part_number']}: {part_name(r['part_number'])}\n")
        now = r["part_number"]
        out.append(f"- **{r['section_id']}**: {r['title']}")
        if r["more"] and r["place"] == 50:
            out.append(f"- and {r['more']} more")
    return "\n".join(out)
