import pytest

from lodestone.plans.cli import parse


@pytest.mark.parametrize(
    ("argv", "want"),
    [
        (["search", "two words", "--part", "2", "--limit=7"], ("search", {"query": "two words", "part": 2, "limit": 7})),
        (["children", "w:tbl", "--profile", "strict"], ("children", {"qname": "w:tbl", "profile": "strict"})),
        (["package-part", "--content-type", "image/png"], ("package_part", {"content_type": "image/png"})),
        (["parts"], ("parts", {})),
    ],
)
def test_commands(argv, want):
    assert parse(argv) == want


@pytest.mark.parametrize("argv", [[], ["fly"], ["search"], ["search", "a", "b"], ["search", "a", "--limit", "21"], ["search", "a", "--part", "0"], ["search", "a", "--part", "x"], ["parts", "1"], ["enum", "x", "--limit", "3"], ["type", "x", "--profile"], ["search", "a", "--part", "1", "--part", "2"]])
def test_faults(argv):
    with pytest.raises(ValueError):
        parse(argv)
