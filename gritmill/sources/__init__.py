"""Readers of scanner output, source trees and manifests."""
