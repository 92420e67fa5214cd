"""Sessions and logins."""

from __future__ import annotations

import hashlib
import hmac
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velumen.functions import argon2

SESSION_DAYS, COOKIE_SECONDS = 1, 28_800


def authenticated(sessions: DataFrame, users: DataFrame, now: Column, *, session_id=None, username: str | None = None) -> DataFrame:
    """(session_id, username) of unexpired sessions, for a session, a user or both."""
    live = sessions.where(F.col("expires_at") > now)
    if session_id is not None:
        live = live.where(F.col("session_id") == F.lit(session_id))
    who = users if username is None else users.where(F.col("username") == username)
    return live.join(who, live["user_id"] == who["id"]).select("session_id", "username")


def is_authenticated(cookie: dict | None, sessions: DataFrame, users: DataFrame, now: Column) -> dict:
    """The check of one cookie's content."""
    if not cookie or "sessionId" not in cookie or "username" not in cookie:
        return {"isAuthenticated": False}
    found = authenticated(sessions, users, now, session_id=cookie["sessionId"], username=cookie["username"]).take(1)
    return {"isAuthenticated": bool(found)} | ({"username": found[0].username, "sessionId": found[0].session_id} if found else {})


def lookup(users: DataFrame, username: str) -> DataFrame:
    return users.where(F.col("username") == username)


def hash_password(password: str, salt: bytes | None = None) -> str:
    """A salted scrypt hash. Other schemes plug into `login` as a verifier."""
    salt = salt or os.urandom(16)
    return f"scrypt${salt.hex()}${hashlib.scrypt(password.encode(), salt=salt, n=2**14, r=8, p=1).hex()}"


def verify_password(stored: str, password: str) -> bool:
    """Whether a password has a stored hash: Argon2 in its usual text form, or ours."""
    if stored.startswith("$argon2"):
        return argon2.verify(stored, password)
    kind, _, rest = stored.partition("$")
    salt = rest.partition("$")[0]
    return kind == "scrypt" and hmac.compare_digest(stored, hash_password(password, bytes.fromhex(salt)))


def login(users: DataFrame, username: str, password: str, verify: Callable[[str, str], bool] = verify_password) -> tuple[str, object]:
    """(event type, user or None): success, or a failure with its reason."""
    from velumen.operators.search import maybe_one

    user = maybe_one(lookup(users, username))
    if user is None:
        return "usernameNotFound", None
    return ("success", user) if verify(user.password_hash, password) else ("passwordIncorrect", None)


def new_sessions(logins: DataFrame, now: Column) -> DataFrame:
    """Session rows for logins (session_id, user_id), for one day."""
    return logins.select("session_id", "user_id", (now + F.expr(f"INTERVAL {SESSION_DAYS} DAY")).alias("expires_at"))


def end_session(sessions: DataFrame, ended: DataFrame) -> DataFrame:
    """Sessions less those in ended (session_id); ids that are null end nothing."""
    gone = ended.select(F.col("session_id").alias("_gone")).where("_gone is not null")
    return sessions.join(gone, sessions["session_id"] == F.col("_gone"), "left_anti")
