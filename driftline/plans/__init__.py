"""Plans of several jobs: distributed scans, expectation-maximisation, gradient fits."""
