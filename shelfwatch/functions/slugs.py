"""Entity rules as columns over host, path and slug."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACES, blank_to_null

# Paths that never name an entity.
EXCLUDED_PATHS = (
    r"/(tag|tags|category|categories|genre|genres|author|user|profile)/",
    r"/(about|contact|privacy|terms|faq|help|search|login|register)/",
    r"/(blog|news|press|careers|jobs|advertise)/",
    r"/(sitemap|robots|feed|rss|atom)($|/|\.|\.xml)",
    r"\.(xml|json|txt|css|js|png|jpg|gif|ico|svg)$",
    r"^/$",
    r"^/[a-z]{2}/?$",
)

# Slugs that are navigation or category pages.
CATEGORY_WORDS = (
    "games", "all-games", "new-games", "hot-games", "popular-games", "trending-games",
    "top-games", "featured-games", "best-games", "free-games", "all-tags", "top-popular",
    "action-games", "adventure-games", "puzzle-games", "racing-games", "sports-games",
    "strategy-games", "shooting-games", "arcade-games", "casual-games", "multiplayer-games",
    "io-games", "html5-games", "girl-games", "boy-games", "kids-games", "girls-games",
    "boys-games", "2-player-games", "multiplayer", "single-player", "about", "contact",
    "privacy", "terms", "faq", "help", "support", "blog", "news", "press", "careers", "jobs",
    "advertise", "category", "categories", "tag", "tags", "genre", "genres", "online",
    "offline", "download", "downloads", "login", "register", "signup", "signin", "search",
    "browse", "index", "home", "recents", "updated", "terms-of-service", "privacy-policy",
    "contact-us", "about-us",
)

# Names that may end in -game or -games.
SUFFIX_NAMES = ("hunger", "squid", "mario", "pokemon", "sonic")


class SiteRule(NamedTuple):
    """Slug rule of the sites whose host contains `host`."""

    host: str
    pattern: str
    prefix: str = ""
    not_slugs: tuple[str, ...] = ()
    not_hosts: tuple[str, ...] = ()


# The first rule whose host text occurs in the host decides alone.
SITE_RULES = (
    SiteRule("poki.com", r"/g/([^/]+)$"),
    SiteRule("coolmathgames.com", r"/\d+-([^/]+)$"),
    SiteRule(
        "itch.io", r"^/([^/]+)$", not_slugs=("jam", "jams", "games", "tools", "assets"), not_hosts=("itch.io",)
    ),
    SiteRule("kongregate.com", r"/games/[^/]+/([^/]+)$"),
    SiteRule("armorgames.com", r"/(?:game|play)/([^/]+)$"),
    SiteRule("newgrounds.com", r"/portal/view/(\d+)$", prefix="newgrounds-"),
    SiteRule("miniclip.com", r"/games/([^/]+)$", not_slugs=("genre",)),
    SiteRule("y8.com", r"/games/([^/]+)$"),
    SiteRule("friv.com", r"/(?:game|play)/([^/]+)$"),
)

# Rules of all other sites, the first match wins: what lies in one of these folders, what ends so, a lone segment.
GAME_FOLDERS = ("games", "game", "play", "g")
GAME_END = r"(?i)/([^/]+)-game$"
PAGE_END = r"(?i)/([^/]+)\.html?$"
# Names that stay as they are; the end is the very end, not the one before a last line break.
_NORMAL = r"^[a-z0-9]++(?:-[a-z0-9]++)*+\z"


def is_content_path(path: Column) -> Column:
    """One combined scan instead of one per exclusion; those that begin with a slash share it."""
    inner = "|".join(f"(?:{p[1:]})" for p in EXCLUDED_PATHS if p.startswith("/"))
    others = "|".join(f"(?:{p})" for p in EXCLUDED_PATHS if not p.startswith("/"))
    return ~path.rlike(f"(?i)/(?:{inner})|{others}")


def _rule_slug(rule: SiteRule, host: Column, path: Column) -> Column:
    slug = blank_to_null(F.regexp_extract(path, rule.pattern, 1))
    allowed = F.lit(True)
    if rule.not_slugs:
        allowed = allowed & ~slug.isin(*rule.not_slugs)
    if rule.not_hosts:
        allowed = allowed & ~host.isin(*rule.not_hosts)
    named = F.concat(F.lit(rule.prefix), slug) if rule.prefix else slug
    return F.when(allowed, named)


def _other_slug(path: Column) -> Column:
    """The rules for all other sites look at the last segment of a path as `url_path` gives it (visible ASCII only)
    and the segment before it, so cutting at slashes serves; only ends in -game and .htm meet a regex."""
    last, lowered = F.substring_index(path, "/", -1), F.lower(path)
    before = F.substr(lowered, F.lit(1), F.length(path) - F.length(last))
    named = reduce(lambda a, b: a | b, [before.endswith(f"/{w}/") for w in GAME_FOLDERS])
    page = lowered.contains(".htm")
    bare = F.when(page, F.regexp_replace(last, r"\.html?$", "")).otherwise(last)

    def ending(pattern: str) -> Column:
        return blank_to_null(F.regexp_replace(F.regexp_extract(path, pattern, 1), r"\.html?$", ""))

    return F.coalesce(
        F.when(named, blank_to_null(bare)),
        F.when(lowered.endswith("-game"), ending(GAME_END)),
        F.when(page, ending(PAGE_END)),
        F.when(F.substring_index(path, "/", 2) == path, F.when(path.startswith("/"), blank_to_null(last))),
    )


def site_slug(host: Column, path: Column, rules: tuple[SiteRule, ...] = SITE_RULES) -> Column:
    chain = reduce(
        lambda acc, rule: acc.when(host.contains(rule.host), _rule_slug(rule, host, path)),
        rules,
        F.when(F.lit(False), F.lit(None).cast("string")),
    )
    return chain.otherwise(_other_slug(path))


def slug_length_ok(slug: Column) -> Column:
    return F.length(slug).between(2, 100)


def not_category(slug: Column) -> Column:
    return ~F.lower(slug).isin(*CATEGORY_WORDS)


def not_suffix(slug: Column) -> Column:
    allowed = "(" + "|".join(SUFFIX_NAMES) + ")-games?$"
    return ~F.lower(slug).rlike("-games?$") | F.lower(slug).rlike(allowed)


def normalize_name(name: Column) -> Column:
    """Names whose lower case is normal already, as most are, pay for one test and no replacement."""
    lowered = F.lower(name)
    dashed = F.regexp_replace(lowered, f"[-_{SPACES}]+", "-")
    ascii_only = F.regexp_replace(dashed, "[^a-z0-9-]", "")
    cleaned = F.regexp_replace(F.regexp_replace(ascii_only, "^-+|-+$", ""), "-+", "-")
    return F.when(lowered.rlike(_NORMAL), lowered).otherwise(cleaned)
