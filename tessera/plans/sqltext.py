"""SQL fragments shared by the reference queries."""


def t_two_sided(t: str, nu: str) -> str:
    """Two-sided Student t tail for whole degrees of freedom: the finite
    trigonometric series of Abramowitz and Stegun 26.7.3-4."""
    theta = f"atan(abs({t}) / sqrt({nu}))"
    even = (
        f"1 - sin({theta}) * list_sum(list_transform(range(0, ({nu} // 2)::BIGINT), "
        f"lambda k: exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1)) * pow(cos({theta}), 2 * k)))"
    )
    odd = (
        f"1 - 2 / pi() * ({theta} + sin({theta}) * coalesce(list_sum(list_transform(range(0, (({nu} - 1) // 2)::BIGINT), "
        f"lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5)) * pow(cos({theta}), 2 * k + 1))), 0))"
    )
    return f"CASE WHEN {nu} % 2 = 0 THEN {even} ELSE {odd} END"


def chi2_even(x: str, m: str) -> str:
    return f"list_sum(list_transform(range(0, {m}), lambda k: exp(k * ln(({x}) / 2) - ({x}) / 2 - lgamma(k + 1))))"


def hypergeometric(k: str, s: str, h: str, u: str) -> str:
    def choose(n, r):
        return f"(lgamma({n} + 1) - lgamma({r} + 1) - lgamma({n} - {r} + 1))"

    term = f"exp({choose(s, 'x')} + {choose(f'({u} - {s})', f'({h} - x)')} - {choose(u, h)})"
    low = f"greatest({k}, {h} + {s} - {u}, 0)"
    return f"least(1.0, list_sum(list_transform(range({low}, least({s}, {h}) + 1), lambda x: {term})))"


def inverse4(name: str) -> tuple[str, str]:
    """Determinant of a 4 x 4 matrix kept as a list, and the rows of its
    inverse by cofactors in terms of a column ``det``."""
    m = lambda a, b: f"{name}[{4 * a + b + 1}]"

    def minor(i, j):
        rr, cc = [a for a in range(4) if a != i], [b for b in range(4) if b != j]
        e = lambda a, b: m(rr[a], cc[b])
        return (f"({e(0, 0)} * ({e(1, 1)} * {e(2, 2)} - {e(1, 2)} * {e(2, 1)}) - {e(0, 1)} * ({e(1, 0)} * {e(2, 2)} - {e(1, 2)} * {e(2, 0)})"
                f" + {e(0, 2)} * ({e(1, 0)} * {e(2, 1)} - {e(1, 1)} * {e(2, 0)}))")

    det = " + ".join(f"{'-' if j % 2 else ''}{m(0, j)} * {minor(0, j)}" for j in range(4))
    inverse = ", ".join(f"[{', '.join(f'{chr(45) if (i + j) % 2 else str()}{minor(j, i)} / det' for j in range(4))}]" for i in range(4))
    return det, inverse
