from ballotframe.sources.inline import inline_table

RESULT = {
    "election_id": "string", "seat": "string", "party": "string", "votes": "bigint", "party_ord": "int",
}


def result(spark, rows, election="e", seat="s"):
    """Rows (party, votes) of one seat, or (seat, party, votes)."""
    full = []
    order: dict[str, int] = {}
    for row in rows:
        where, party, votes = row if len(row) == 3 else (seat, *row)
        order[where] = order.get(where, -1) + 1
        full.append((election, where, party, votes, order[where]))
    return inline_table(spark, RESULT, full)


def seats(spark, rows):
    """Rows (seat, region, electorate)."""
    return inline_table(spark, {"seat": "string", "region": "string", "electorate": "bigint"}, rows)


def near(value, expected, tol=1e-9):
    return value is not None and abs(value - expected) <= tol


def by(df, *keys):
    """Collected rows of a small frame, by key."""
    rows = [r.asDict() for r in df.collect()]
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in rows}
