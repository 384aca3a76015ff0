"""DataFrame operators over records, detections, decisions and benchmark rows."""
