"""What share of random strings of each class the entropy spans find, and which names they leave alone."""

import random
import string

import pytest

from factloom.llm import secrets

CLASSES = {
    "base32": lambda r: "".join(r.choices(string.ascii_uppercase + "234567", k=32)),
    "capitals and digits": lambda r: "".join(r.choices(string.ascii_uppercase + string.digits, k=24)),
    "small letters and digits": lambda r: "".join(r.choices(string.ascii_lowercase + string.digits, k=24)),
    "mixed": lambda r: "".join(r.choices(string.ascii_letters + string.digits, k=32)),
    "xoxb": lambda r: f"xoxb-{r.randrange(10**11, 10**12)}-{r.randrange(10**12, 10**13)}-" + "".join(r.choices(string.ascii_letters + string.digits, k=24)),
    "address with a key": lambda r: "example.org/api/v1/users?".rstrip("?") + "/" + "".join(r.choices(string.ascii_letters + string.digits, k=28)),
}


@pytest.mark.parametrize("kind", CLASSES)
def test_random_strings_are_found(kind):
    rng, scan = random.Random(9), secrets.Scan()
    texts = [CLASSES[kind](rng) for _ in range(1000)]
    found = sum(bool(secrets.entropy_spans(f"see {t} here", scan)) for t in texts)
    assert found >= 950, found


NAMES = (
    "getUserAccountByExternalIdentifier", "/usr/local/lib/python3.13/site-packages/numpy/core", "MAX_CONNECTION_RETRY_COUNT_V2", "this-is-a-long-slug-of-words-2024-05-01", "com.example.project.module.ClassName2",
    "customer_account_balance_2023_q4", "IMG_20240501_123456789.jpeg", "release-notes-version-10.4.12-beta2", "ThisIsAVeryLongTitleInCamelCase2024", "internationalization_and_localization",
)


@pytest.mark.parametrize("name", NAMES)
def test_names_are_left_alone(name):
    assert secrets.entropy_spans(f"see {name} here", secrets.Scan()) == []
