"""Schemas of the records on the wire and in the lake."""

from __future__ import annotations

# Field names of the JSON records.
READING = "struct<temperature: double, humidity: double, vibration: double, deviceType: string, deviceLocation: string>"
PROCESSED_EVENT = ("deviceId string, eventId string, timestamp string, status string, "
                   f"enrichedData {READING}")
SENSORS = ("temperature", "humidity", "vibration")
ENRICHED = "enrichedData."
ENGINEERED = "feat_"

TOPIC_RECEIVED = "device-data-received"
TOPIC_PROCESSED = "device-data-processed"
TOPIC_ENRICHED = "device-data-enriched"
TOPIC_ALERTS = "alert-created"
TOPIC_PREDICTIONS = "ml-predictions"
TOPIC_ANOMALIES = "ml-anomalies"
TOPIC_DEAD_LETTERS = "device-data-received-dlt"

ENVELOPE_DEFAULTS = {"event_type": "DeviceTelemetryEvent", "version": "1.0"}
