"""Phishing-mail analytics on Spark: message facts, signals, risk, campaigns, incidents and response views."""
