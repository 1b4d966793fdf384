"""Storage advice: probes of the data, rules, sort keys, the rewrite with its report, and the script that does it."""
