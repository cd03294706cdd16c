"""Version roots, and commits that their author built: what their members must be, and what they hash to.

mark is the name under which a store's format carries its protocol number.
"""

from __future__ import annotations

import datetime
import hashlib
import re

from .canonical import SAFE_INTEGER, InputError, check_type, jcs, next_semver, semver

HEX = re.compile("[0-9a-f]{64}")
# Fixed values of the format.
PROTOCOL, VERSION_PREFIX = 2, "ulv2:"
SUMMARY, TYPE, SET, PRIVATE_SET = {"root", "count", "bytes"}, {"root", "count", "bytes", "schema"}, {"types", "files"}, {"types", "files", "salt"}
SKEW = datetime.timedelta(minutes=10)


def _hex(x: object) -> bool:
    return isinstance(x, str) and HEX.fullmatch(x) is not None


def _whole(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and float(x).is_integer() and 0 <= x <= SAFE_INTEGER


def _summary(x: object, members: set[str]) -> str | None:
    if not isinstance(x, dict):
        return "not an object"
    if not (x.get("root", 0) is None or _hex(x.get("root"))):
        return "bad root"
    for name in ("count", "bytes"):
        if not _whole(x.get(name)):
            return f"bad {name}"
    if (x["root"] is None) != (x["count"] == 0) or (x["root"] is None and x["bytes"]):
        return "root and totals disagree"
    return None if x.keys() == members else "unexpected members"


def check_set(x: object, private: bool = False) -> str | None:
    """What is wrong with a set of trees by type and a tree of files, or None. A private one has a salt."""
    if not isinstance(x, dict) or not isinstance(x.get("types"), dict):
        return "bad types"
    if x.keys() != (PRIVATE_SET if private else SET):
        return "unexpected members"
    if private and not _hex(x["salt"]):
        return "bad salt"
    for slug, t in x["types"].items():
        try:
            check_type(slug)
        except InputError:
            return f"type {slug}: bad name"
        problem = _summary(t, TYPE) or (None if _hex(t["schema"]) else "bad schema")
        if problem:
            return f"type {slug}: {problem}"
    problem = _summary(x["files"], SUMMARY)
    if problem:
        return f"files: {problem}"
    return "empty" if private and not x["types"] and x["files"]["root"] is None else None


def check_root(x: object, mark: str) -> str | None:
    """What is wrong with a version's root, or None."""
    if not isinstance(x, dict) or x.keys() != {mark, "metadata", "public", "private"}:
        return "unexpected members"
    if x[mark] != PROTOCOL:
        return "another protocol"
    if not (x["metadata"] is None or isinstance(x["metadata"], dict)):
        return "bad metadata"
    if not (x["private"] is None or _hex(x["private"])):
        return "bad commitment"
    problem = check_set(x["public"])
    return f"public: {problem}" if problem else None


def private_commitment(private: dict) -> str:
    return hashlib.sha256(jcs(private).encode()).hexdigest()


def version_hash(root: dict) -> str:
    return VERSION_PREFIX + hashlib.sha256(jcs(root).encode()).hexdigest()


def make_root(metadata: dict | None, public: dict, private: dict | None, mark: str) -> dict:
    """A root; of the private set it holds a commitment only, and none of an empty one."""
    hidden = private is not None and (private["types"] or private["files"]["root"] is not None)
    return {mark: PROTOCOL, "metadata": metadata, "public": public, "private": private_commitment(private) if hidden else None}


def check_author_commit(commit: dict, head: dict | None, files: list, bump: str, now: datetime.datetime, collection: str, skew: datetime.timedelta = SKEW) -> str | None:
    """Why a commit that its author built cannot be the next one, "stale" if another came first, or None.

    commit and head have number, id, previous, semver, createdAt and changes, each with files.
    """
    wanted = head["number"] + 1 if head else 1
    if commit.get("collection") != collection:
        return "collection"
    if commit["number"] > wanted:
        return "number"
    if commit["number"] < wanted or commit["previous"] != (head["id"] if head else None):
        return "stale"
    if commit.get("sig") or any(c.get("sig") for c in commit["changes"]):
        return "signed"
    if len(commit["changes"]) != 1:
        return "changes"
    if jcs(commit["changes"][0]["files"]) != jcs(files):
        return "files"
    if semver(commit["semver"]) != next_semver(semver(head["semver"]) if head else None, bump):
        return "semver"
    try:
        at = datetime.datetime.fromisoformat(commit["createdAt"])
    except ValueError:
        return "time"
    if abs(at - now) > skew or (head and at < datetime.datetime.fromisoformat(head["createdAt"])):
        return "time"
    return None


def receipt(commit: dict, server: str, at: datetime.datetime) -> dict:
    """That a version was accepted as a number at a time. It lies beside the commit, so the version's id does not depend on who keeps it."""
    return {"collection": commit["collection"], "number": commit["number"], "version": commit["id"], "receivedAt": at.isoformat(), "server": server}


def receipt_fits(r: dict, commit: dict) -> bool:
    return (r["collection"], r["number"], r["version"]) == (commit["collection"], commit["number"], commit["id"])
