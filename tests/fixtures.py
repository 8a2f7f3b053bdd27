"""Input rows the jobs are shown on (readings and logins are fixed values)."""

HELLO_LINES = ["hello there", "hello world", "hello again", "one more line now", "the end c"]

SENSOR_ROWS = [
    ("sensor_1", 1547718199, 35.8),
    ("sensor_6", 1547718201, 15.4),
    ("sensor_7", 1547718202, 6.7),
    ("sensor_10", 1547718205, 38.1),
    ("sensor_1", 15477181129, 36.8),
    ("sensor_6", 1547718212, 25.4),
    ("sensor_7", 1547718231, 3.7),
    ("sensor_10", 1547718225, 28.1),
    ("sensor_10", 1547718225, 38.1),
    ("sensor_10", 1647718266, 48.1),
]

# (userId, loginState, timestamp) of the users with a failure, in file order.
LOGIN_ROWS = [
    (23064, "fail", 1558430826),
    (5692, "fail", 1558430833),
    (5692, "success", 1558430840),
    (1035, "fail", 1558430842),
    (1035, "fail", 1558430843),
    (1035, "fail", 1558430844),
    (76456, "success", 1558430853),
    (76456, "success", 1558430857),
    (76456, "success", 1558430854),
    (76456, "fail", 1558430859),
    (76456, "success", 1558430861),
    (76456, "success", 1558430865),
    (23565, "fail", 1558430862),
    (23565, "success", 1558430881),
    (23565, "success", 1558430884),
    (83419, "success", 1558430881),
    (83419, "fail", 1558430882),
    (83419, "success", 1558430885),
    (83419, "fail", 1558430886),
    (83419, "success", 1558430884),
    (83419, "success", 1558430886),
]

def click_rows():
    """(seq, userId, adId, province, timestamp), made up: one user clicks the same ad every second, others now and then."""
    start = 1_700_000_000
    busy = [(i, 7, 70, "north", start + i) for i in range(130)]
    others = [
        (130 + i, 100 + i % 9, 70 + i % 4, ("south", "east", "west")[i % 3], start + 37 * i) for i in range(40)
    ]
    return busy + others


def rows(df, *order):
    """Rows as tuples, in a stable order."""
    found = [tuple(r) for r in df.collect()]
    return sorted(found, key=lambda r: tuple((v is None, v) for v in r)) if not order else found
