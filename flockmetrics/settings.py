"""Scores, tiers, patterns and formats. Everything here can be replaced by the caller."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class TierRule:
    """A rung: its level, its label and the least value of each measure that reaches it."""

    level: int
    label: str
    at_least: Mapping[str, int]


@dataclass(frozen=True)
class Weights:
    likes: int
    recasts: int
    replies: int


# --- Fixed values: they decide the results and are stated as they must be. ---

ENGAGEMENT_WEIGHTS = Weights(likes=1, recasts=3, replies=10)
TIER_SCORE_WEIGHTS = Weights(likes=1, recasts=5, replies=10)

USER_TIERS = (
    TierRule(4, "💎 vip", {"followers": 50000, "casts": 10, "score": 50000}),
    TierRule(3, "🥇 influencer", {"followers": 10000, "casts": 10, "score": 25000}),
    TierRule(2, "🥈 star", {"followers": 1000, "casts": 5, "score": 5000}),
    TierRule(1, "🥉 active", {"followers": 400, "casts": 1, "score": 500}),
    TierRule(0, "🤖 npc", {}),
)
# Last week's ladder asks for a lower score on the "active" rung.
USER_TIERS_LAST = (
    *USER_TIERS[:3],
    TierRule(1, "🥉 active", {"followers": 400, "casts": 1, "score": 100}),
    USER_TIERS[4],
)
# "leaders" are influencers and vips together.
CHANNEL_TIERS = (
    TierRule(4, "👑 stadium", {"casts": 250, "engagement": 100000, "leaders": 10}),
    TierRule(3, "🎭 subculture", {"casts": 100, "engagement": 25000, "stars": 50, "leaders": 2}),
    TierRule(2, "🔍 niche", {"casts": 25, "engagement": 5000, "casters": 100}),
    TierRule(1, "🍻 friends", {"casts": 5, "engagement": 50}),
    TierRule(0, "💤 quiet", {}),
)

LINK_START = "https://"
LINK_PATTERN = r"https://\S*"
PUNCTUATION = r"[\p{Punct}\p{P}]"
ADDRESS_PATTERN = "0x[a-fA-F0-9]{40}"
TAG_PATTERN = "<[^>]+>"
IGNORED_DOMAINS = ("warpcast.com", "x.com", "twitter.com")
PROFILE_URL = "https://warpcast.com/"
CHANNEL_URL = "https://warpcast.com/~/channel/"
SPACER = "||"
RESULT_LIMIT = 1000
MIN_CASTERS = 10
PREVIEW_ROWS = 20

# Frequent words that say nothing about a topic; removed in addition to the stopword table.
COMMON_WORDS = tuple(
    """
    today like follow recast get good join lets new left back great know nice done need think
    guys people thank hello bro lol much really right thats hot cool use yes no also everyone
    something post whats come many sure ill take keep every well ive even anyone always big made
    could using feel never find ready thing followers better let already looking look say try yet
    miss give coming getting last yeah fam happy hope days start things gonna another please lot
    wait amazing users user around week worth share joined man following trying guy might though
    since waiting actually less anything seems haha makes may stuff ago finally definitely
    everything end shit fuck damn lmao bad one first comment time see got make still want day way
    cant going would next real cast reply click help hey nothing free love similar seem worked
    basically directly especially likely probably exactly totally fully currently usually
    absolutely truly recently simply literally via sir heres idk either omg thanks
    """.split()
)

# --- End of the fixed values. ---


@dataclass(frozen=True)
class Settings:
    """``repeat_likes`` counts a post's likes and recasts once per reply it received (at least
    once) when they are summed per user, which is what the published user scores do; switch it
    off to count every reaction once. ``approx_casters`` counts weekly casters of a channel with
    a sketch of relative error ``sketch_error`` instead of exactly."""

    engagement: Weights = ENGAGEMENT_WEIGHTS
    tier_score: Weights = TIER_SCORE_WEIGHTS
    user_tiers: tuple[TierRule, ...] = USER_TIERS
    user_tiers_last: tuple[TierRule, ...] = USER_TIERS_LAST
    channel_tiers: tuple[TierRule, ...] = CHANNEL_TIERS
    punctuation: str = PUNCTUATION
    ignored_domains: tuple[str, ...] = IGNORED_DOMAINS
    common_words: tuple[str, ...] = field(default=COMMON_WORDS, repr=False)
    min_casters: int = MIN_CASTERS
    repeat_likes: bool = True
    approx_casters: bool = False
    sketch_error: float = 0.023
