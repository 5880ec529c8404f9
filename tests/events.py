"""Access events for the tests: times and rows."""

from __future__ import annotations

from datetime import datetime


def at(text: str) -> datetime:
    """``HH:MM:SS[.ffffff]`` on a fixed Monday, or a full date and time."""
    text = text if " " in text else f"2024-03-04 {text}"
    return datetime.fromisoformat(text)


def row(ts, status="success", country="Spain", resource="dashboard", user="u1", risk=0, event_id=None, ip="10.1.2.3"):
    ts = at(ts) if isinstance(ts, str) else ts
    return dict(event_id=event_id, ts=ts, user_id=user, ip_address=ip, country=country, action="access", status=status,
                resource=resource, risk_score=risk, scenario="normal")
