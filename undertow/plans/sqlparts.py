"""SQL fragments for tail probabilities, used by the checks only."""


def t_tail(t: str, df: str, steps: int = 4000) -> str:
    """Two-sided t tail by Simpson's rule over the angle whose tangent is t / sqrt(df)."""
    h = f"(atan(abs({t}) / sqrt({df})) / {steps})"
    weight = f"(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    area = f"list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * pow(cos(i * {h}), {df} - 1.0)))"
    return f"(1 - 2 / sqrt(pi()) * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) * {h} / 3 * {area})"


def f_tail_even(f: str, d1: int, d2: str) -> str:
    """F tail for an even first degree of freedom, as a finite sum."""
    x = f"({d2} / ({d2} + {d1} * ({f})))"
    a = f"({d2} / 2.0)"
    terms = " + ".join(
        ["1"] + [f"exp(lgamma({a} + {i}) - lgamma({a}) - lgamma({i + 1})) * pow(1 - {x}, {i})" for i in range(1, d1 // 2)]
    )
    return f"(pow({x}, {a}) * ({terms}))"


def normal_cdf(z: str, steps: int = 2000) -> str:
    """Standard normal distribution function by Simpson's rule from 0 to |z|."""
    h = f"(abs({z}) / {steps})"
    weight = f"(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    area = f"(list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * exp(-(i * {h}) * (i * {h}) / 2))) * {h} / 3 / sqrt(2 * pi()))"
    return f"(0.5 + sign({z}) * {area})"
