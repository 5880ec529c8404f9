"""Writing alerts, logs and notifications."""
