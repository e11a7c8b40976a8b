"""Travel profiles: how much longer each kind of way feels. Data, not code."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Profile:
    """Weights of ways (1.0 is neutral; steps None can't be passed) and speeds in metres a minute."""

    id: str
    tier: str = "normal"
    walk_speed: float = 80
    max_walk_seconds: int = 3600
    steps: float | None = 1.2
    steps_no_handrail: float | None = None
    elevator: float = 1.0
    incline: float = 1.3
    narrow: float | None = None
    unpaved: float = 1.2
    busy_road: float = 1.3
    covered: float = 1.0
    cycleway: float = 1.0
    bike_sidewalk: float = 1.0
    stroller: bool = False
    transit: bool = False
    graph_mode: str = "walk"
    reach: bool = False
    months: tuple[int, int] | None = None
    barriers: dict[str, float] = field(default_factory=dict)

    def relaxed(self) -> Profile:
        """Steps can be passed at a price; for where nothing else is found."""
        return replace(self, steps=6.0, stroller=False)

    def plain(self) -> Profile:
        """The same pace with every weight at 1."""
        return replace(self, steps=1.0, steps_no_handrail=None, elevator=1.0, incline=1.0, narrow=None, unpaved=1.0, busy_road=1.0, covered=1.0, cycleway=1.0, bike_sidewalk=1.0, stroller=False, barriers={})

    def graph_speed(self) -> float:
        return 220.0 if self.graph_mode == "bike" else float(self.walk_speed)


def _barriers(step_2: float, step_5: float, step_10: float, narrow: float, slope: float, steep: float, roof: float) -> dict[str, float]:
    return {"step_over_2cm": step_2, "step_over_5cm": step_5, "step_over_10cm": step_10, "narrow": narrow, "slope": slope, "steep": steep, "roof": roof}


# The weights of each way of travelling and of each age band.
_WALK = _barriers(1.2, 1.8, 3.0, 1.3, 1.2, 1.8, 0.95)
MODES = {
    p.id: p
    for p in (
        Profile("walk", incline=1.2, unpaved=1.1, busy_road=1.4, cycleway=0.7, bike_sidewalk=0.8, reach=True, barriers=_WALK),
        Profile("bike", incline=1.3, unpaved=1.4, busy_road=1.6, cycleway=0.7, bike_sidewalk=0.9, graph_mode="bike", reach=True, barriers=_WALK),
        Profile("stroller", tier="stroller", walk_speed=70, steps=None, elevator=0.7, incline=2.0, narrow=1.8, unpaved=1.5, busy_road=1.4, covered=0.85, stroller=True, barriers=_barriers(1.8, 4.0, 8.0, 2.2, 1.6, 2.8, 0.88)),
        Profile("transit", max_walk_seconds=1200, incline=1.2, unpaved=1.1, busy_road=1.4, cycleway=0.7, bike_sidewalk=0.8, transit=True, reach=True, barriers=_WALK),
    )
}
BANDS = (
    Profile("prenatal", "gentle", 65, 720, 3.0, 4.5, 0.8, 2.0, None, 1.4, 1.3, 0.9, months=(-10, -1), barriers=_barriers(1.4, 2.5, 4.0, 1.6, 1.8, 3.0, 0.9)),
    Profile("baby", "stroller", 70, 900, None, None, 0.7, 2.2, 2.0, 1.6, 1.4, 0.85, stroller=True, months=(0, 23), barriers=_barriers(1.8, 4.0, 8.0, 2.2, 1.6, 2.8, 0.88)),
    Profile("toddler", "stroller", 70, 900, None, None, 0.7, 2.0, 1.8, 1.5, 1.4, 0.85, stroller=True, months=(24, 47), barriers=_barriers(1.7, 3.5, 7.0, 2.0, 1.5, 2.6, 0.88)),
    Profile("preschool", "gentle", 65, 900, 1.6, None, 0.9, 1.4, None, 1.2, 1.8, 0.95, 0.8, 0.85, months=(48, 83), barriers=_WALK),
    Profile("school", "normal", 80, 1200, 1.2, None, 1.0, 1.2, None, 1.1, 1.6, 1.0, 0.7, 0.8, months=(84, 156), barriers=_WALK),
)


def for_months(months: int, bands: tuple[Profile, ...] = BANDS) -> Profile:
    """The band that holds the age; past all the last, before all the first."""
    for band in bands:
        if band.months and band.months[0] <= months <= band.months[1]:
            return band
    return bands[-1] if months > 0 else bands[0]
