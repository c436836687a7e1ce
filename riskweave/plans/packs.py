"""Default rules as plain records, and their schemas. Patterns and exclusions are data: a caller reads their own."""

from __future__ import annotations

from dataclasses import dataclass, field

PATTERN = "name string, regex string, prefix string, severity string, score_weight int, min_matches int, hotwords array<string>, hotword_window int, hotword_boost int, require_hotword boolean, entropy_min double, category string, content_types array<string>"
EXCLUSION = "applies_to string, type string, words array<string>, pattern string, window int, match_type string, suppress boolean"
CONTENT_TYPES = ("code", "structured", "credentials", "natural")


@dataclass(frozen=True)
class Pattern:
    name: str
    regex: str
    prefix: str = ""
    severity: str = "medium"
    score_weight: int = 1
    min_matches: int = 0
    hotwords: tuple[str, ...] = ()
    hotword_window: int = 0
    hotword_boost: int = 0
    require_hotword: bool = False
    entropy_min: float = 0.0
    category: str = "uncategorized"
    content_types: tuple[str, ...] = ()


@dataclass(frozen=True)
class Exclusion:
    applies_to: str = "*"
    type: str = "dictionary"
    words: tuple[str, ...] = ()
    pattern: str = ""
    window: int = 0
    match_type: str = "proximity"
    suppress: bool = False


@dataclass(frozen=True)
class ScanConfig:
    """Weights, thresholds by severity, disabled categories, the size from which only critical and high patterns count (0: none), and whether long texts are searched near the prefixes' places only."""

    hotword: int = 2
    entropy_boost: int = 1
    entropy_penalty: int = -2
    exclusion: int = -3
    multi_match: int = 1
    ml: int = 0
    thresholds: dict[str, int] = field(default_factory=lambda: {"critical": 1, "high": 2, "medium": 3, "low": 4})
    disabled: tuple[str, ...] = ()
    large: int = 51_200
    windowed: bool = False


PATTERNS = [
    Pattern("email", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]{2,}", "@", "low", 2, hotwords=("mail", "contact", "write"), hotword_window=60, category="pii"),
    Pattern("token assignment", r"token = \"[0-9a-f]{40}\"", "token = ", "critical", 3, entropy_min=3.0, category="secrets"),
    Pattern("password assignment", r"password=[0-9a-f]{12,}", "password=", "high", 3, entropy_min=2.5, category="secrets"),
    Pattern("access key", r"AKIA[A-Z0-9]{16}", "akia", "critical", 2, entropy_min=3.0, category="secrets"),
    Pattern("ipv4", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "", "low", 2, min_matches=1, category="network"),
    Pattern("phone", r"\([0-9]{3}\) 555-[0-9]{4}", ") 555-", "medium", 2, hotwords=("call", "phone", "+1"), hotword_window=20, category="pii"),
    Pattern("card number", r"4[0-9]{15}", "4", "high", 2, hotwords=("card",), hotword_window=50, require_hotword=False, category="finance"),
]
EXCLUSIONS = [
    Exclusion("*", "dictionary", ("sample", "placeholder", "dummy"), window=50),
    Exclusion("card number", "dictionary", ("4111111111111111", "4242424242424242"), match_type="exact"),
    Exclusion("email", "regex", pattern=r"@mail[0-3]\.example\.com", suppress=True),
    Exclusion("ipv4", "regex", pattern=r"^(10|127|192\.168)\.", suppress=False),
]
#: (category, entry); an entry with a leading dot also fits subdomains. Earlier sources win.
DOMAINS = [
    [("AI Chat DLP", ".example.com"), ("Social", ".example.net"), ("Phishing", "thering.example.org")],
    [("News", ".example.org"), ("block_admin", "therha.example.net"), ("allow_admin", ".example.com")],
]
POLICIES = [("AI Chat Blocked", "deny"), ("AI Code Blocked", "deny"), ("AI Allowed", "allow"), ("AI Chat DLP", "allow_with_dlp"), ("Phishing", "deny"), ("Social", "allow"), ("News", "allow"), ("allow_admin", "allow"), ("block_admin", "deny")]
