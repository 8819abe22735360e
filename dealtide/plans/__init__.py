"""Plan fragments that several operators share: outlier trimming, change roll-ups, newest batches, holds."""
