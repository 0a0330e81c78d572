import datetime as dt


def post(uid, reply_to=(), text="", author=None, at=None, platform="Twitter", tags=(), lang=None, convo="c", seq=None):
    when = dt.datetime(2020, 12, 1, *at) if at else None
    return (convo, seq if seq is not None else int(uid) if str(uid).isdigit() else 0, str(uid), text, author, when, [None if r is None else str(r) for r in reply_to], platform, list(tags), lang)


def pairs(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["uid"], set()).add(r["member"])
    return out
