"""Keyed draws in SQL, for the twins of queries that draw partners."""

from ..operators import draws
from ..operators.sampling import SEED


def number(text: str, first: int = 1, digits: int = 8) -> str:
    """A whole number from hexadecimal digits of a hash; text is what follows the seed."""
    return f"CAST('0x' || substr(md5('{SEED}' || {text}), {first}, {digits}) AS BIGINT)"


def key(template: str, *columns: str) -> str:
    return f"sha256('{SEED}:{template}:' || " + " || ':' || ".join(columns) + ")"


def common(name: str, left: str, right: str, template: str, attempts: int, tried: int, low: int = 1, rounds: int = 3) -> str:
    """Tables up to ``name`` (anchor, partner, overlap, nth): what ``draws.common`` gives, in so many rounds at most."""
    pick = "(m.slot - a.start + a.slots) % a.slots < least(a.slots, CAST(floor(CAST(least({t}, a.everything) AS DOUBLE) * CAST(a.slots AS DOUBLE) / CAST(a.everything AS DOUBLE) + CAST(a.part AS DOUBLE) / {fraction}) AS BIGINT))"
    parts = [f"""{name}_l AS (SELECT DISTINCT anchor, x FROM {left}), {name}_r AS (SELECT DISTINCT partner, x FROM {right}),
{name}_h AS (SELECT x, count(*) AS degree, greatest(1, count(*) // {draws.SLOT}) AS slots FROM {name}_r GROUP BY 1),
{name}_m AS (SELECT partner, x, {number("':' || x || ':' || partner")} % slots AS slot FROM {name}_r JOIN {name}_h USING (x)),
{name}_a AS (SELECT anchor, x, slots, {number("':' || anchor || ':' || x")} % slots AS start, {number("':' || anchor || ':' || x", 9, 5)} AS part, sum(degree) OVER (PARTITION BY anchor) AS everything FROM {name}_l JOIN {name}_h USING (x))"""]
    for i in range(rounds):
        open_ = "" if not i else f" WHERE everything > {tried} AND " + " AND ".join(f"anchor NOT IN (SELECT anchor FROM {name}_f{k})" for k in range(i))
        if i:
            tried *= draws.MORE
        parts.append(f"""{name}_c{i} AS (SELECT a.anchor, m.partner, a.x FROM (SELECT * FROM {name}_a{open_}) a JOIN {name}_m m ON m.x = a.x AND m.partner <> a.anchor AND {pick.format(t=tried, fraction=draws.FRACTION)}),
{name}_o{i} AS (SELECT c.anchor, c.partner, count(*) AS overlap, min(l.x) AS x FROM (SELECT DISTINCT anchor, partner FROM {name}_c{i}) c JOIN {name}_l l USING (anchor) JOIN {name}_r r ON r.partner = c.partner AND r.x = l.x GROUP BY 1, 2 HAVING count(*) >= {low}),
{name}_f{i} AS (SELECT anchor, partner, overlap, row_number() OVER (PARTITION BY anchor ORDER BY {key(template, 'anchor', 'partner')}, partner) AS nth FROM {name}_o{i} JOIN {name}_c{i} USING (anchor, partner, x) QUALIFY nth <= {attempts})""")
    parts.append(f"{name} AS (" + " UNION ALL ".join(f"SELECT * FROM {name}_f{i}" for i in range(rounds)) + ")")
    return ", ".join(parts)


def apart(name: str, anchors: str, left: str, right: str, template: str) -> str:
    """Tables up to ``name`` (anchor, partner): what ``draws.apart`` gives, for up to 65,536 partners."""
    first, second, third = (draws.REJECTIONS * draws.MORE**k for k in range(3))
    return f"""{name}_l AS (SELECT DISTINCT anchor, x FROM {left}), {name}_r AS (SELECT DISTINCT partner, x FROM {right}),
{name}_p AS (SELECT partner, row_number() OVER (ORDER BY partner) - 1 AS number, count(*) OVER () AS total FROM (SELECT DISTINCT partner FROM {name}_r)),
{name}_n AS (SELECT max(total) AS total, max(CASE WHEN {second} > total // 4 THEN {first} WHEN {third} > total // 4 THEN {second} ELSE {third} END) AS tries FROM {name}_p),
{name}_i AS (SELECT anchor, i, p.partner FROM (SELECT anchor, i, {number(f"':{template}:' || anchor || ':' || i", digits=15)} % total AS number FROM {anchors}, {name}_n, range({third}) AS t(i) WHERE i < tries) JOIN {name}_p p USING (number)),
{name}_1 AS (SELECT anchor, min_by(partner, i) AS partner FROM {name}_i c WHERE anchor <> partner AND (anchor, partner) NOT IN (SELECT (c.anchor, c.partner) FROM {name}_i c JOIN {name}_l l USING (anchor) JOIN {name}_r r ON r.partner = c.partner AND r.x = l.x) GROUP BY 1),
{name}_t AS (SELECT anchor, partner FROM {anchors}, {name}_p WHERE anchor NOT IN (SELECT anchor FROM {name}_1)),
{name}_2 AS (SELECT anchor, min_by(partner, {key(template, 'anchor', 'partner')}) AS partner FROM {name}_t WHERE anchor <> partner AND (anchor, partner) NOT IN (SELECT (c.anchor, c.partner) FROM {name}_t c JOIN {name}_l l USING (anchor) JOIN {name}_r r ON r.partner = c.partner AND r.x = l.x) GROUP BY 1),
{name} AS (SELECT * FROM {name}_1 UNION ALL SELECT * FROM {name}_2)"""
