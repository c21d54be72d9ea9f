"""pulseframe: wearable and respiratory-device analytics expressed as Spark DataFrame plans."""
