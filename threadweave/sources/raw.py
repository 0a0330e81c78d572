"""Raw platform messages (parsed JSON) to rows of the universal schema.

Formats that nest to any depth or must not have unknown keys are parsed in Python, in Arrow
batches; see ``parsed``. A row is (uid, text, author, epoch seconds, reply_to, platform, tags, lang).
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = ["uid", "text", "author", "created", "reply_to", "platform", "tags", "lang"]
_SHAPE = "uid string, text string, author string, created double, reply_to array<string>, platform string, tags array<string>, lang string"


def _each(stems: dict[str, str]) -> frozenset[str]:
    return frozenset(stem + end for stem, ends in stems.items() for end in ends.split())


TWEET_IGNORED = _each(
    {
        "in_reply_to_": "user_id user_id_str screen_name status_id_str status_created_at",
        "quoted_status_": "permalink id_str",
        "withheld_": "scope copyright in_countries",
        "possibly_": "sensitive_appealable sensitive",
        "": "entities extended_entities metadata source place geo coordinates contributors scopes trends truncated filter_level display_text_range favorited retweeted is_quote_status id_str retweet_count favorite_count",
    }
)
TWEET_ENTITIES_IGNORED = frozenset("trends user_mentions symbols hashtags".split())
FACEBOOK_IGNORED = frozenset("message description name place first_party type source story replies updated_time shares picture link caption".split())
FACEBOOK_TEXT = ("name", "description", "story", "caption", "message")
REDDIT_IGNORED = _each(
    {
        "author_": "cakeday",
        "author_flair_": "type text_color text template_id richtext css_class background_color",
        "link_flair_": "type text_color text template_id richtext css_class background_color",
        "subreddit_": "type subscribers name_prefixed id",
        "is_": "video submitter self reddit_media_domain original_content meta crosspostable",
        "thumbnail_": "width height",
        "num_": "reports crossposts comments",
        "mod_": "reports reason_title reason_by note",
        "secure_": "media_embed media",
        "": "wls pwls ups downs url subreddit thumbnail score likes kind gilded edited domain depth delta count clicked hidden locked saved pinned preview stickied spoiler visited permalink quarantine"
        " whitelist_status parent_whitelist_status violated_rule view_count user_reports report_reasons upvote_ratio suggested_sort send_replies selftext_html body_html score_hidden hide_score rte_mode"
        " removal_reason previous_visits post_hint post_categories content_categories over_18 no_follow media_only media_embed media link_id distinguished controversiality contest_mode collapsed_reason"
        " collapsed category can_mod_post can_gild banned_by banned_at_utc archived approved_by approved_at_utc",
    }
)


def _when(text: str, form: str) -> float:
    return dt.datetime.strptime(text, form).replace(tzinfo=dt.timezone.utc).timestamp()


def _row(uid, text, author, created, reply_to: Iterable, platform: str, tags: Iterable[str] = (), lang=None) -> tuple:
    as_text = lambda x: None if x is None else str(x)
    return as_text(uid), text or "", as_text(author), created, [as_text(x) for x in dict.fromkeys(reply_to)], platform, list(dict.fromkeys(tags)), lang


def tweet(data: dict) -> list[tuple]:
    """A tweet of API 1.1 and the tweets it quotes, those first. Links are written out; a tweet without text is left out.

    A null ``in_reply_to_status_id`` is a null reply target. Links are replaced as they are, not as patterns. Unknown keys raise.
    """
    out, reply, author, created, uid, lang = [], [], None, None, None, None
    text = data.get("full_text", data.get("text"))
    for key, value in data.items():
        if key in TWEET_IGNORED or key in ("full_text", "text"):
            continue
        if key == "created_at":
            created = _when(value, "%a %b %d %H:%M:%S +0000 %Y")
        elif key == "id":
            uid = value
        elif key == "lang":
            lang = value
        elif key in ("in_reply_to_status_id", "quoted_status_id"):
            reply.append(value)
        elif key == "user":
            author = value["screen_name"]
        elif key == "quoted_status":
            out += tweet(value)
        else:
            raise KeyError(f"a tweet with an unknown key: {key}")
    for key, links in (data.get("entities") or {}).items():
        if key not in ("media", "urls"):
            if key not in TWEET_ENTITIES_IGNORED:
                raise KeyError(f"entities with an unknown key: {key}")
            continue
        for link in links:
            text = (text or "").replace(link["url"], link["display_url" if key == "media" else "expanded_url"])
    if text:
        out.append(_row(uid, text, author, created, reply, "Twitter", (), lang))
    return out


def _facebook_time(text: str) -> float:
    return _when(text, "%Y-%m-%dT%H:%M:%S+0000")


def facebook(data, kind: str, parent: str | None = None) -> list[tuple]:
    """A Facebook object of kind 'post', 'comments' or 'replies'; other kinds raise ValueError, unknown keys KeyError."""
    if kind not in ("post", "comments", "replies"):
        raise ValueError(f"no kind of Facebook object: {kind}")
    if not data:
        return []
    if kind == "post":
        for key in data:
            if key not in FACEBOOK_IGNORED and key not in ("created_time", "id"):
                raise KeyError(f"a post with an unknown key: {key}")
        text = " ".join(data[k] for k in FACEBOOK_TEXT if k in data).strip()
        created = _facebook_time(data["created_time"]) if "created_time" in data else None
        return [_row(data.get("id"), text, None, created, (), "Facebook", [f"type={data['type']}"] if "type" in data else ())]
    out = []
    for item in data["data"] if isinstance(data, dict) else data:
        for key in item:
            if key not in ("id", "message", "created_time", "userID", "response", "from") and not (key == "replies" and kind == "replies"):
                raise KeyError(f"{kind} with an unknown key: {key}")
        if kind == "replies" and item.get("replies"):
            out += facebook(item["replies"], kind, item["id"])
        created = _facebook_time(item["created_time"]) if "created_time" in item else None
        out.append(_row(item.get("id"), item.get("message"), item.get("userID"), created, [parent] if parent else (), "Facebook"))
    return out


OF_FOLDER = "\x01folder"  #: the reply target of what is below the post of a folder, as long as that isn't known


def facebook_file(data, kind: str) -> list[tuple]:
    """What a file of a kind holds; comments and replies reply to ``OF_FOLDER``. A row of nulls stands for a file without messages, as those of kind 'none' are."""
    return (facebook(data, kind, OF_FOLDER) if kind != "none" else []) or [(None,) * len(NAMES)]


def reddit(data) -> list[tuple]:
    """A Reddit thing, listing or list of things with all replies, those first. Unknown keys raise KeyError."""
    if isinstance(data, list):
        return [row for x in data if isinstance(x, dict) for row in reddit(x)]
    if "kind" in data and "data" in data:
        inner = data["data"]
        return [row for child in inner["children"] for row in reddit(child["data"])] if data["kind"] == "Listing" else reddit(inner)
    out, parts, title, author, reply = [], [], None, None, []
    for key, value in data.items():
        if key in REDDIT_IGNORED:
            continue
        if key in ("author", "author_name"):
            author = value
        elif key in ("body", "selftext"):
            parts.append(value)
        elif key == "title":
            title = value
        elif key == "parent_id":
            reply.append(re.sub(r"t\d_", "", value))
        elif key in ("replies", "children"):
            if value:
                out += reddit(value)
        elif key not in ("created", "created_utc", "id", "name"):
            raise KeyError(f"a Reddit post with an unknown key: {key}")
    uid = data.get("id", data.get("name"))
    created = data.get("created", data.get("created_utc"))
    if uid != "_":
        out.append(_row(uid, "\n".join(([title] if title is not None else []) + parts), author, None if created is None else float(created), reply, "Reddit"))
    return out


def reddit_flat(data: dict) -> list[tuple]:
    """A comment or submission of the flat format, tagged with its board; other types raise ValueError."""
    board, kind = [f"board={data['subreddit']}"], data["type"]
    if kind == "comment":
        return [_row(data["id"], data["body"], data["author"], float(data["created_utc"]), [re.sub("t[1-5]_", "", data["parent_id"])], "Reddit", board)]
    if kind == "submission":
        return [_row(data["id"], f"{data['title']} {data['selftext']}", data["author"], float(data["created_utc"]), (), "Reddit", board)]
    raise ValueError(f"no type of Reddit post: {kind}")


def reddit_ad_hominem(data: dict) -> list[tuple]:
    """Like ``reddit``, tagged AH=1 if the post violates rule 2, else AH=0."""
    tag = "AH=1" if data["violated_rule"] == 2 else "AH=0"
    return [(*row[:6], [*row[6], tag], row[7]) for row in reddit(data)]


def loads_all(line: str) -> Iterator:
    """The JSON values of a line, also if several stand one after the other."""
    decoder, at = json.JSONDecoder(), 0
    line = line.strip()
    while at < len(line):
        value, at = decoder.raw_decode(line, at)
        yield value
        while at < len(line) and line[at].isspace():
            at += 1


class Members:
    """The values of the members of JSON objects that come in pieces of text; what is done with is let go."""

    def __init__(self):
        self.text, self.at, self.depth, self.decoder = "", 0, 0, json.JSONDecoder()

    def feed(self, more: str, last: bool = False) -> Iterator:
        """The values that are whole by now; with ``last`` all must be."""
        self.text, self.at = self.text[self.at :] + more, 0
        while True:
            at = self._space(self.at)
            if at == len(self.text):
                break
            if not self.depth:
                if self.text[at] != "{":
                    raise ValueError("a file that isn't made of objects")
                at, self.depth = self._space(at + 1), 1
                if at == len(self.text):
                    self.depth = 0
                    break
                self.at = at
                if self.text[at] == "}":
                    self.at, self.depth = at + 1, 0
                continue
            try:
                key, at = self.decoder.raw_decode(self.text, at)
                at = self._space(at)
                if not isinstance(key, str) or self.text[at : at + 1] not in ("", ":"):
                    raise ValueError("no member of an object")
                value, at = self.decoder.raw_decode(self.text, self._space(at + 1))
            except json.JSONDecodeError:
                if last:
                    raise
                break
            at = self._space(at)
            if at == len(self.text):
                break
            if self.text[at] not in ",}":
                raise ValueError("no end of a member")
            if self.text[at] == "}":
                self.depth = 0
            self.at = at + 1
            yield value
        if last and (self.depth or self._space(self.at) < len(self.text)):
            raise ValueError("a file that ends within an object")

    def _space(self, at: int) -> int:
        while at < len(self.text) and self.text[at] in " \t\r\n":
            at += 1
        return at


def parsed_members(pieces: DataFrame, parse: Callable[..., list[tuple]]) -> DataFrame:
    """``(file, place)`` and rows of the universal schema from files of objects, by the values of their members; ``pieces``: see ``readers._pieces``.

    A member that is there twice counts twice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, members, place = None, Members(), 0

        def taken(values: Iterator) -> Iterator[pd.DataFrame]:
            nonlocal place
            rows = []
            for value in values:
                for row in parse(value):
                    rows.append((file, place, *row))
                    place += 1
            if rows:
                yield pd.DataFrame(rows, columns=["file", "place", *NAMES])

        for pdf in batches:
            for name, values in pdf.groupby("file", sort=False)["value"]:
                text = ",".join(values)
                if name == file:
                    text = "," + text
                else:
                    yield from taken(members.feed("", True))
                    file, members, place = name, Members(), 0
                yield from taken(members.feed(text))
        yield from taken(members.feed("", True))

    made = pieces.mapInPandas(run, f"file string, place int, {_SHAPE}")
    return made.withColumn("created_at", F.timestamp_micros((F.col("created") * 1e6).cast("bigint"))).drop("created")


def parsed(source: DataFrame, parse: Callable[..., list[tuple]], keys: dict[str, str], arguments: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the universal schema from a table with a column ``value`` of JSON.

    ``keys`` (name to type) are columns that stay with the rows; ``parse`` gets each JSON value and the named ``arguments``. ``seq`` numbers
    the rows of a key in order of (``line``, place).
    """
    kept = ", ".join(f"{n} {t}" for n, t in keys.items())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                i = 0
                for value in loads_all(r["value"]):
                    for row in parse(value, *[r[a] for a in arguments]):
                        rows.append((*[r[k] for k in keys], r["line"], i, *row))
                        i += 1
            yield pd.DataFrame(rows, columns=[*keys, "line", "place", *NAMES])

    wanted = source.select(*keys, *[a for a in arguments if a not in keys], "line", "value")
    made = wanted.mapInPandas(run, f"{kept}, line string, place int, {_SHAPE}")
    return made.withColumn("created_at", F.timestamp_micros((F.col("created") * 1e6).cast("bigint"))).drop("created")
