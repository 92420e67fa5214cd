"""The catalogue's actions as a whole: each does its work and appends its event to the log."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velumen.functions import shape
from velumen.operators import auth, events, search
from velumen.sources.schema import DEFAULT_MODEL, model_column


class NotAuthorized(PermissionError):
    pass


@dataclass
class Service:
    """images, users and sessions are tables; told collects (event_type, payload) until `flush` appends them to the log."""

    images: DataFrame
    users: DataFrame
    sessions: DataFrame
    clock: Callable[[], float] = time.perf_counter
    told: list[tuple[str, dict]] = field(default_factory=list)

    def __post_init__(self):
        self.spark = self.images.sparkSession

    def tell(self, event_type: str, **payload) -> None:
        known = events.VOCABULARY.get(event_type)
        if known is not None and set(payload) != set(known):
            raise ValueError(f"{event_type} has the keys {known}")
        self.told.append((event_type, payload))

    def pending(self) -> DataFrame:
        """The events told and not yet flushed: event_type, payload. One action gives one event, so they are few."""
        rows = [(kind, *(None if p.get(k) is None else str(p[k]) for k in _KEYS)) for kind, p in self.told]
        df = self.spark.createDataFrame(rows, "event_type string, " + ", ".join(f"`{k}` string" for k in _KEYS))
        numbers = {k: F.col(f"`{k}`").cast("double") for k in _NUMBERS}
        return df.select("event_type", F.to_json(F.struct(*[numbers.get(k, F.col(f"`{k}`")).alias(k) for k in _KEYS])).alias("payload"))

    def flush(self, path: str, log: DataFrame, now) -> None:
        events.append_to(path, log, self.pending(), now)
        self.told.clear()

    # Reading --------------------------------------------------------------------------------------------------

    def random(self, **options) -> list:
        began = self.clock()
        found = search.many(search.random_gallery(self.images, **options))
        self.tell("getRandom", results=len(found), time=self._since(began))
        return found

    def similar(self, id_, *, model: str = DEFAULT_MODEL, **options) -> list:
        """The target's record and those of its nearest; nothing, and no event, for an unknown id."""
        began = self.clock()
        found = search.similar_records(self.images, id_, column=self._column(model), **options).orderBy("rank").collect()
        if found:
            self.tell("getImageByIdAndSimilar", id=id_, results=len(found) - 1, time=self._since(began))
        return found

    def search(self, q: str, encoder, *, model: str = DEFAULT_MODEL, **options) -> list:
        """Hits of a text; nothing, and no event, for empty text."""
        if q == "":
            return []
        began = self.clock()
        query = encoder.embed(q)[0]
        ready = self.clock()
        found = search.within(self.images, query, column=self._column(model), **options).collect()
        self.tell("vectorSearchByString", model=model, q=q, results=len(found), embedTime=(ready - began) * 1000, dbTime=self._since(ready), totalTime=self._since(began))
        return found

    def cover_bytext(self, params: dict[str, str], encoder, **options) -> tuple[int, str]:
        """Status and body of the search address: 400 without a query, else the hits' addresses as JSON."""
        q = params.get("q")
        if not q:
            return 400, "No query provided"
        hits = self.search(q, encoder, **options)
        return 200, json.dumps([{"versions": {"png": {"original": f"{shape.DEFAULT_PREFIX}/original/{r.id}.{r.extension}"}}} for r in hits], separators=(",", ":"))

    def downloaded(self, id_) -> None:
        self.tell("imageDownloaded", id=id_)

    def _since(self, began: float) -> float:
        return (self.clock() - began) * 1000

    def _column(self, model: str) -> str:
        column = model_column(model)
        return column if column in self.images.columns else "embedding"

    # Sessions -------------------------------------------------------------------------------------------------

    def authenticated(self, cookie: str | None, now) -> dict:
        """The check of a cookie's text; success is told."""
        if not cookie:
            return {"isAuthenticated": False}
        parsed = self.spark.range(1).select(shape.decode_cookie(F.lit(cookie)).alias("c")).first().c
        found = auth.is_authenticated(parsed.asDict() if parsed else None, self.sessions, self.users, now)
        if found["isAuthenticated"]:
            self.tell("adminUserAuthSuccess", sessionId=found["sessionId"], username=found["username"])
        return found

    def login(self, username: str, password: str, now, *, token: Callable[[], str] = shape.token, verify=auth.verify_password) -> dict:
        """status, and after success the session's row, the cookie's text and its age; either outcome is told."""
        kind, user = auth.login(self.users, username, password, verify)
        if kind != "success":
            self.tell("adminUserLoginFailure", username=username, reason=kind)
            return {"status": 401}
        session = token()
        row = auth.new_sessions(self.spark.createDataFrame([(session, user.id)], "session_id string, user_id long"), now)
        self.sessions = self.sessions.unionByName(row.select(*[F.col(c).cast(self.sessions.schema[c].dataType).alias(c) for c in self.sessions.columns]))
        self.tell("adminUserLoginSuccess", username=username, sessionId=session)
        cookie = self.spark.range(1).select(shape.encode_cookie(F.lit(session), F.lit(user.username))).first()[0]
        return {"status": 303, "location": "/admin", "session": row, "cookie": cookie, "max_age": auth.COOKIE_SECONDS}

    def logout(self, session_id) -> None:
        ended = self.spark.createDataFrame([(session_id,)], "session_id string").select(F.col("session_id").cast(self.sessions.schema["session_id"].dataType))
        self.sessions = auth.end_session(self.sessions, ended)
        self.tell("adminUserLogout")

    # Flags ----------------------------------------------------------------------------------------------------

    def _set(self, cookie: str | None, now, id_, flag: str, value: bool, event_type: str) -> None:
        who = self.authenticated(cookie, now)
        if not who["isAuthenticated"]:
            raise NotAuthorized("Not authorized")
        self.images = self.images.withColumn(flag, F.when(F.col("id") == F.lit(id_), F.lit(value)).otherwise(F.col(flag)))
        self.tell(event_type, id=id_, username=who["username"], sessionId=who["sessionId"])

    def set_deleted(self, cookie: str | None, now, id_, value: bool) -> None:
        self._set(cookie, now, id_, "deleted", value, "imageDeleted" if value else "imageUndeleted")

    def set_searchable(self, cookie: str | None, now, id_, value: bool) -> None:
        self._set(cookie, now, id_, "searchable", value, "setImageSearchable" if value else "setImageNotSearchable")


_KEYS = sorted({k for keys in events.VOCABULARY.values() for k in keys})
_NUMBERS = ("results", "time", "embedTime", "dbTime", "totalTime")
